"""More queries: validation, tables, segments, queues, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as ck
from ..functions import fields as fd
from ..functions import values as vl
from ..functions import text as tx
from ..operators import classify, costs, evaluate, tables
from ..operators.layout import spread
from ..sources.views import items, jobs, table
from .extract_queries import pick, sql_pick
from .queries import ITEMS, JOBS, _round, query


@query(f"""{JOBS} SELECT doc_type, count(*) AS total, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'failed') AS n_failed, round(avg(confidence), 6) AS avg_confidence FROM jobs
 WHERE created_at >= (SELECT max(created_at) FROM jobs) - INTERVAL 20 DAYS GROUP BY 1""")
def type_stats(spark, sf):
    j = jobs(spark, sf)
    last = F.broadcast(j.agg(F.max("created_at").alias("last")))  # one row
    recent = j.crossJoin(last).where(F.col("created_at") >= F.col("last") - F.expr("INTERVAL 20 DAYS"))
    out = recent.groupBy("doc_type").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("n_done"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.avg("confidence").alias("avg_confidence"))
    return _round(out, "avg_confidence")


@query("""WITH t AS (SELECT event_id AS id, event_id % 7 AS ocr, event_id % 5 AS classify, event_id % 11 AS extract, event_id % 3 AS validate FROM events)
 SELECT id, CASE greatest(ocr, classify, extract, validate) WHEN ocr THEN 'ocr' WHEN classify THEN 'classify' WHEN extract THEN 'extract' ELSE 'validate' END AS step FROM t""")
def bottleneck_step(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_id").alias("id"), *[(F.col("event_id") % m).alias(n) for n, m in (("ocr", 7), ("classify", 5), ("extract", 11), ("validate", 3))])
    return t.select("id", ck.bottleneck(("ocr", "classify", "extract", "validate")).alias("step"))


@query("""WITH t AS (SELECT user_id AS owner, CASE WHEN event_id % 4 <> 0 THEN event_id % 100 END AS p, CASE WHEN event_id % 6 <> 0 THEN event_id % 50 END AS o FROM events)
 SELECT owner, count(*) AS calls, CAST(coalesce(sum(p), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(o), 0) AS BIGINT) AS output, count(*) FILTER (p IS NULL AND o IS NULL) AS unknown FROM t GROUP BY 1""")
def token_accumulator(spark, sf):
    t = table(spark, sf, "events").select(F.col("user_id").alias("owner"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100).alias("p"), F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 50).alias("o"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return t.groupBy("owner").agg(F.count("*").alias("calls"), zero("p").alias("prompt"), zero("o").alias("output"), F.count_if(F.col("p").isNull() & F.col("o").isNull()).alias("unknown"))


@query(f"{JOBS} SELECT id, CASE WHEN status = 'needs_review' AND owner % 2 = 0 THEN 'done' ELSE status END AS status, status = 'needs_review' AND owner % 2 = 0 AS approved FROM jobs")
def review_transitions(spark, sf):
    ok = (F.col("status") == "needs_review") & (F.col("owner") % 2 == 0)
    return jobs(spark, sf).select("id", F.when(ok, "done").otherwise(F.col("status")).alias("status"), ok.alias("approved"))


@query("SELECT event_id, user_id % 13 AS attempts FROM events WHERE event_id % 3 <> 0 AND user_id % 13 < 10 ORDER BY ts, event_id LIMIT 50")
def inbox_drain(spark, sf):
    e = table(spark, sf, "events").withColumn("attempts", F.col("user_id") % 13)
    return e.where("event_id % 3 <> 0 AND attempts < 10").orderBy("ts", "event_id").limit(50).select("event_id", "attempts")


@query(f"{JOBS} SELECT id, status FROM jobs WHERE status IN ('done', 'failed', 'needs_review') AND id % 5 = 0 AND owner % 6 < 5 AND created_at < (SELECT max(created_at) FROM jobs) - INTERVAL 1 HOUR")
def webhook_retry(spark, sf):
    j = jobs(spark, sf)
    last = F.broadcast(j.agg(F.max("created_at").alias("last")))  # one row
    due = F.col("status").isin("done", "failed", "needs_review") & (F.col("id") % 5 == 0) & (F.col("owner") % 6 < 5)
    return j.where(due).crossJoin(last).where(F.col("created_at") < F.col("last") - F.expr("INTERVAL 1 HOUR")).select("id", "status")


@query("""SELECT o_orderkey, concat_ws(';', CASE WHEN NOT o_totalprice BETWEEN 0 AND 1e12 THEN 'o_totalprice out of range' END, CASE WHEN o_custkey = buyer THEN 'o_custkey equals buyer' END,
 CASE WHEN CAST(o_orderdate AS DATE) < DATE '1993-01-01' OR CAST(o_orderdate AS DATE) > DATE '1998-01-01' THEN 'o_orderdate out of range' END) AS issues FROM (SELECT *, o_orderkey % 97 AS buyer FROM orders) t""")
def validate_orders(spark, sf):
    specs = ("money_sanity:o_totalprice", "parties_differ:o_custkey,buyer", "no_such_rule:x", "date_range:o_orderdate,1993-01-01,1998-01-01")
    return table(spark, sf, "orders").withColumn("buyer", F.col("o_orderkey") % 97).select("o_orderkey", F.array_join(ck.issues(specs), ";").alias("issues"))


@query(f"""{ITEMS}, s AS (SELECT doc, sum(total) AS summed FROM items GROUP BY 1) SELECT doc, round(summed - o_totalprice, 2) AS off FROM s JOIN orders ON doc = o_orderkey WHERE abs(summed - o_totalprice) > greatest(1, 0.01 * abs(o_totalprice))""")
def positions_sum(spark, sf):
    s = items(spark, sf).groupBy("doc").agg(F.sum("total").alias("summed"))
    off = F.col("summed") - F.col("o_totalprice")
    return s.join(table(spark, sf, "orders"), F.col("doc") == F.col("o_orderkey")).where(F.abs(off) > F.greatest(F.lit(1.0), 0.01 * F.abs("o_totalprice"))).select("doc", F.round(off, 2).alias("off"))


@query(f"""{ITEMS}, s AS (SELECT doc, sum(total) AS total, sum(total / (1 + rate / 100)) AS net FROM items GROUP BY 1), v AS (SELECT *, total - net AS vat, (total - net) / net * 100 AS implied FROM s),
 r AS (SELECT doc, arg_min(c, abs(implied - c)) AS rate FROM v, (VALUES (0), (5), (7), (10), (18), (20), (22)) t(c) WHERE abs(implied - c) <= 0.6 GROUP BY 1)
 SELECT doc, round(total, 2) AS total, round(net, 2) AS net, round(vat, 2) AS vat, rate FROM v LEFT JOIN r USING (doc)""")
def header_totals(spark, sf):
    return tables.header_totals(items(spark, sf), ck.TAX_RATES).withColumns({c: F.round(c, 2) for c in ("total", "net", "vat")})


CATEGORIES = (("metal", ("steel", "brass", "copper", "tin", "nickel")), ("finish", ("polished", "plated", "brushed", "anodized", "burnished")), ("size", ("small", "medium", "large", "economy", "promo", "standard")))
_HITS = [" + ".join(f"contains(t, '{w}')::INT" for w in words) for _, words in CATEGORIES]


@query(f"""WITH h AS (SELECT p_partkey, {', '.join(f'{h} AS h{i}' for i, h in enumerate(_HITS))} FROM (SELECT p_partkey, lower(p_type || ' ' || p_name) AS t FROM part) p)
 SELECT p_partkey, CASE greatest(h0, h1, h2) WHEN 0 THEN 'other' WHEN h0 THEN 'metal' WHEN h1 THEN 'finish' ELSE 'size' END AS category FROM h""")
def categorize_items(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("t"))
    return tables.categorize(p, "t", CATEGORIES).drop("t")


@query("""WITH r AS (SELECT user_id % 50 AS sheet, event_id AS idx, (event_id * event_id + user_id) % 6 AS width FROM events), n AS (SELECT sheet, width, count(*) AS n FROM r GROUP BY 1, 2), m AS (SELECT sheet, arg_max(width, (n, width)) AS mode FROM n GROUP BY 1),
 t AS (SELECT *, abs(width - mode) <= 1 AS fits, row_number() OVER (PARTITION BY sheet ORDER BY idx) AS row FROM r JOIN m USING (sheet)), i AS (SELECT *, row - sum(fits::INT) OVER (PARTITION BY sheet ORDER BY idx) AS island FROM t),
 g AS (SELECT sheet, mode, island, min(idx) AS start, count(*) AS run_rows FROM i WHERE fits GROUP BY 1, 2, 3) SELECT sheet, mode, start, run_rows FROM g QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY run_rows DESC, start) = 1""")
def longest_table_run(spark, sf):
    e = table(spark, sf, "events")
    return tables.longest_run(e.select((F.col("user_id") % 50).alias("sheet"), F.col("event_id").alias("idx"), ((F.col("event_id") * F.col("event_id") + F.col("user_id")) % 6).alias("width")))


@query("""WITH p AS (SELECT conv_id AS file, turn AS page, CASE WHEN length(text) >= 100 THEN role END AS strong FROM conversations), b AS (SELECT *, last_value(strong IGNORE NULLS) OVER (PARTITION BY file ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
 s AS (SELECT *, CAST(sum(coalesce(strong <> before, false)::INT) OVER (PARTITION BY file ORDER BY page) + 1 AS BIGINT) AS segment FROM b)
 SELECT file, segment, max(strong) AS type, CASE WHEN min(page) = max(page) THEN min(page)::VARCHAR ELSE min(page) || '-' || max(page) END AS pages, count(*) AS n_pages FROM s GROUP BY 1, 2""")
def segment_turns(spark, sf):
    c = table(spark, sf, "conversations")
    return tables.segments(c.select(F.col("conv_id").alias("file"), F.col("turn").alias("page"), F.col("role").alias("type"), F.length("text").alias("n_chars")))


@query("""WITH c AS (SELECT unnest(string_split(text, chr(10))) AS cell FROM documents), n AS (SELECT cell, count(*) AS n FROM c WHERE length(cell) >= 15 GROUP BY 1 HAVING count(*) >= 5)
 SELECT sha256(cell) AS sha, n, (n - 1) * length(cell) AS saved FROM n ORDER BY saved DESC, cell LIMIT 60""")
def cell_dictionary(spark, sf):
    cells = table(spark, sf, "documents").select(F.explode(F.split("text", "\n", -1)).alias("cell"))
    return tables.cell_dictionary(cells).select(F.sha2(F.col("cell").cast("binary"), 256).alias("sha"), "n", "saved")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n, CASE WHEN contains(text, chr(10)) THEN length(string_split(text, chr(10))[1]) END AS first_chars FROM documents WHERE contains(text, chr(10))")
def formfeed_split(spark, sf):
    pages = ck.split_pages(F.translate("text", "\n", "\f"))
    return table(spark, sf, "documents").select("doc_id", pages.alias("p")).where(F.size("p") > 0).select("doc_id", F.size("p").cast("long").alias("n"), F.length(F.element_at("p", 1)).cast("long").alias("first_chars"))


@query("""WITH b AS (SELECT l_orderkey AS id, 'items.' || l_linenumber AS path, l_quantity AS v FROM lineitem WHERE l_linenumber <> 3), a AS (SELECT l_orderkey AS id, 'items.' || l_linenumber AS path, l_quantity + CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS v FROM lineitem WHERE l_linenumber <> 2)
 SELECT id, path, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (id, path) WHERE a.v IS DISTINCT FROM b.v""")
def diff_extracted(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("items."), F.col("l_linenumber")).alias("path"), F.col("l_quantity").alias("value"), "l_linenumber")
    after = t.where("l_linenumber <> 2").select("id", "path", (F.col("value") + F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(0.0)).alias("value"))
    return tables.diff(t.where("l_linenumber <> 3").select("id", "path", "value"), after)


@query("""SELECT lang, count(quality) AS n_expected, count(*) FILTER (quality = toxic) AS n_matched, round(CASE WHEN count(quality) = 0 THEN 1 ELSE count(*) FILTER (quality = toxic) / count(quality) END, 6) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def eval_recall(spark, sf):
    t = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return _round(tables.recall(t.select("lang", F.col("quality").alias("expected"), F.col("toxic").alias("actual")), "lang"), "recall")


@query("SELECT conv_id, list_sort(list(DISTINCT role)) = ['assistant', 'user'] AS same FROM conversations GROUP BY 1")
def type_set_match(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.array_sort(F.collect_set("role")) == F.array(F.lit("assistant"), F.lit("user"))).alias("same"))


@query("SELECT o_orderkey, strftime(o_orderdate, '20%y-%m-%d') AS day FROM orders")
def find_date(spark, sf):
    text = F.concat(F.lit("Invoice 7 of "), F.date_format("o_orderdate", "d.M.yy"), F.lit(" paid"))
    return table(spark, sf, "orders").select("o_orderkey", fd.find_date(text).alias("day"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN translate('A' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || 'BC' || '77', 'ABC', 'АВС') END AS plate FROM customer")
def plate_canonical(spark, sf):
    raw = F.concat(F.lit("a "), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.when(F.col("c_custkey") % 5 > 0, F.lit("bc-77")).otherwise(F.lit("zz-77")))
    return table(spark, sf, "customer").select("c_custkey", ck.plate(raw).alias("plate"))


@query("""WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '7') AS d FROM customer), v AS (SELECT c_custkey, (((2 * d[1]::INT + 4 * d[2]::INT + 10 * d[3]::INT + 3 * d[4]::INT + 5 * d[5]::INT + 9 * d[6]::INT + 4 * d[7]::INT + 6 * d[8]::INT + 8 * d[9]::INT) % 11) % 10) = d[10]::INT AS valid FROM c)
 SELECT c_custkey, CASE WHEN valid THEN 0.95 WHEN c_custkey % 2 = 0 THEN 0.4 ELSE 0.3 END::DOUBLE AS confidence FROM v""")
def field_confidence(spark, sf):
    inn = F.lpad(F.col("c_custkey").cast("string"), 10, "7")
    given = F.when(F.col("c_custkey") % 2 == 0, F.lit(0.8))
    return table(spark, sf, "customer").select("c_custkey", ck.inn_confidence(vl.inn_valid(inn), F.length(inn), given).alias("confidence"))


@query(r"""WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^\p{L}\p{N}]', '', 'g') AS a, regexp_replace(lower(p_type), '[^\p{L}\p{N}]', '', 'g') AS t, regexp_replace(lower(p_name[1:(p_partkey % 9)::INT]), '[^\p{L}\p{N}]', '', 'g') AS b FROM part)
 SELECT p_partkey, a = '' OR contains(a, CASE WHEN p_partkey % 2 = 0 THEN t ELSE b END) OR contains(CASE WHEN p_partkey % 2 = 0 THEN t ELSE b END, a) AS same FROM n""")
def name_containment(spark, sf):
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.substring("p_name", F.lit(1), (F.col("p_partkey") % 9).cast("int")))
    return table(spark, sf, "part").select("p_partkey", ck.names_match(F.col("p_name"), other).alias("same"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'text' WHEN event_id % 13 = 0 THEN 'image' WHEN event_id % 7 = 0 OR event_type = 'error' OR value / 1000 < 0.7 OR event_id % 500 < (event_id % 4) * 80 THEN 'image' ELSE 'text' END AS route FROM events""")
def extract_route(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    force = F.coalesce(F.when(i % 11 == 0, "text").when(i % 13 == 0, "image"), F.lit("none"))
    return e.select("event_id", ck.extract_route(force, i % 7 == 0, F.col("event_type") == "error", F.col("value") / 1000, i % 500, i % 4).alias("route"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'pdf' WHEN 'view' THEN 'image' WHEN 'click' THEN 'xml' WHEN 'error' THEN 'excel' ELSE 'other' END AS kind FROM events")
def format_kind(spark, sf):
    mime = F.when(F.col("event_type") == "purchase", "application/pdf").when(F.col("event_type") == "view", "image/png").when(F.col("event_type") == "click", "text/xml").when(F.col("event_type") == "error", "application/x-cfb").otherwise("text/plain")
    return table(spark, sf, "events").select("event_id", ck.format_kind(mime, F.lit("Book.XLS")).alias("kind"))


#: A region's daily feed has an entry for each of its nations: what its suppliers hold, for 1, 10 or 100 units.
FEED_SQL = """WITH v AS (SELECT n_regionkey AS region, n_nationkey AS k, 'X' || chr(65 + CAST(n_nationkey % 26 AS INTEGER)) || 'Q' AS code, [1, 10, 100][CAST(n_nationkey % 3 + 1 AS INTEGER)] AS nominal, round(abs(sum(s_acctbal)), 2) AS value FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
 f AS (SELECT region, code, value / nominal AS rate, nominal, DATE '2026-02-01' + CAST(region AS INTEGER) AS day FROM v WHERE value IS NOT NULL)"""


def daily_feeds(spark, sf):
    """region, xml: a feed of rates for each region."""
    held = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.abs(F.sum("s_acctbal")).alias("value"))
    n = table(spark, sf, "nation").join(held, "n_nationkey", "left")
    k = F.col("n_nationkey")
    value = F.when(F.col("value").isNotNull(), F.concat(F.lit("<Value>"), F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(",")), F.lit("</Value>"))).otherwise("")
    entry = F.concat(F.lit('<Valute ID="'), k.cast("string"), F.lit('"><CharCode>X'), F.char(65 + k % 26), F.lit("Q</CharCode><Nominal>"), F.element_at(F.array(F.lit("1"), F.lit("10"), F.lit("100")), (k % 3 + 1).cast("int")), F.lit("</Nominal>"), value, F.lit("</Valute>"))
    head = F.concat(F.lit("<ValCurs Date='"), F.date_format(F.date_add(F.lit("2026-02-01").cast("date"), F.col("region").cast("int")), "dd.MM.yyyy"), F.lit("'>"))
    feeds = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("entries"))
    return feeds.select("region", F.concat(head, F.col("entries"), F.lit("</ValCurs>")).alias("xml"))


@query(f"{FEED_SQL} SELECT region, code, round(rate, 6) AS rate, nominal, strftime(day, '%Y-%m-%d') AS day FROM f")
def fx_feed(spark, sf):
    rates = daily_feeds(spark, sf).select("region", F.explode(ck.fx_feed(F.col("xml"))).alias("r"))
    return rates.select("region", "r.code", F.round("r.rate", 6).alias("rate"), "r.nominal", F.col("r.day").cast("string").alias("day"))


@query(FEED_SQL + """, w AS (SELECT DISTINCT 'X' || chr(65 + CAST(c_nationkey % 26 AS INTEGER)) || 'Q' AS code, c_nationkey AS k FROM customer UNION SELECT 'GBP', NULL UNION SELECT 'CHF', NULL), o AS (SELECT code, rate, day FROM f WHERE region < 3)
 SELECT code, round(CASE WHEN rate > 0 THEN rate WHEN code = 'GBP' THEN 90.0 WHEN code IN ('XAQ', 'XMQ') THEN 1.5 END, 6)::DOUBLE AS rate, CASE WHEN rate > 0 THEN 'bank:' || strftime(day, '%Y-%m-%d') WHEN code IN ('GBP', 'XAQ', 'XMQ') THEN 'config' ELSE 'none' END AS source FROM w LEFT JOIN o USING (code)""")
def resolve_rates(spark, sf):
    """Rates of the customers' currencies from three regions' feeds, else configured, else none."""
    daily = daily_feeds(spark, sf).where("region < 3").select(F.explode(ck.fx_feed(F.col("xml"))).alias("r")).select("r.*")
    wanted = table(spark, sf, "customer").select(F.concat(F.lit("x"), F.char(65 + F.col("c_nationkey") % 26), F.lit("q")).alias("code")).distinct().unionByName(spark.createDataFrame([("gbp",), ("CHF",)], "code string"))
    return costs.resolve_rates(wanted, daily, {"GBP": 90.0, "XAQ": 1.5, "XMQ": 1.5}).withColumn("rate", F.round("rate", 6))


_KINDS = ("string", "money", "percent", "date", "inn", "kpp", "account", "plate", "country", "integer", "number")
_EXPECTED = ("«Acme», Ltd.", "1 200,50 руб.", "20 %", "01.02.2025", "77-01", "770101001", "4070 2810", "a 123-bc", " lv", "7.4", "12,345")
_SAME = ("acme ltd", "1200.5 ₽", "0.2", "2025-02-01T10:00", "7701", "7701 01001", "40702810", "A123BC", "LV", "6,5", "12.349")
_OTHER = ("acme", "1200.6", "0.18", "2025-02-02", "7702", "", "4070", "A124BC", "LT", "9", "12.4")
_PATHS = ("name", "total_amount", "vat_rate", "doc_date", "seller.inn", "kpp", "bank_account", "vehicle.plate", "origin_country", "line_no", "weight_net")
_GUESSED = ("string", "money", "percent", "date", "inn", "kpp", "account", "plate", "country", "string", "number")


@query(f"""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'match' WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 11 = 5 THEN 'missing' ELSE 'mismatch' END ELSE 'missing' END AS outcome, {sql_pick('event_id', _GUESSED)} AS guessed FROM events""")
def comparators(spark, sf):
    k = F.col("event_id")
    actual = F.when(k % 3 == 0, pick(k, _SAME)).when(k % 3 == 1, pick(k, _OTHER))
    return table(spark, sf, "events").select(k.alias("id"), evaluate.outcome(pick(k, _KINDS), pick(k, _EXPECTED), actual).alias("outcome"), evaluate.kind_of(pick(k, _PATHS)).alias("guessed"))


@query("""SELECT page_id, 'x' || chr(10) || chr(10) || '| k | v' || page_id || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| A & \\| é | |' || chr(10) || chr(10) || 'end' AS markdown FROM pages""".replace("\\\\", "\\"))
def table_to_markdown(spark, sf):
    html = F.concat(F.lit("x<table><tr><th>k</th><th> v"), F.col("page_id"), F.lit("</th></tr><tr><td>A &amp; |<br/>&#233;</td></tr></table>end"))
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(tx.html_to_markdown(html), " +", " ").alias("markdown"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, sum(CASE WHEN length(x) + 1 > 12000 THEN ceil(length(x) / 12000) ELSE 0 END)::BIGINT AS pieces FROM l GROUP BY 1 HAVING max(length(x)) >= 12000""")
def long_line_pieces(spark, sf):
    d = table(spark, sf, "documents").where(F.length("text") >= 12_000)
    lines = d.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("x")).where(F.length("x") >= 12_000)
    return lines.groupBy("doc_id").agg(F.sum(F.size(tx.chunks(F.col("x")))).alias("pieces"))


@query()
def prompt_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.chunks(F.col("text")).alias("c")).select("doc_id", F.size("c").alias("n"), F.length(F.element_at("c", -1)).alias("last_chars"))


@query(f"""SELECT event_id AS id, {sql_pick('event_id', ('UPD', 'TTN', 'invoice', 'AKT', 'waybill', None, 'CMR'))} AS slug, round({sql_pick('event_id', (1.0, 1.0, 1.0, 0.95, 1.0, None, 1.0))}::DOUBLE, 6) AS score, {sql_pick('event_id', ('invoice', None, None, None, None, None, 'TTN'))} AS runner_up FROM events""")
def classify_business_text(spark, sf):
    far = " filler" * 100
    texts = ("УПД № %s" + far + " счёт", "Транспортная накладная %s", "Счёт на оплату %s", far + " акт выполненных работ %s", "Путевой лист %s", "nothing %s", "CMR %s" + far + " ттн")
    text = F.replace(pick(F.col("event_id"), texts), F.lit("%s"), F.col("event_id").cast("string"))
    out = classify.classify(spread(table(spark, sf, "events").select("event_id"), "event_id").select(F.col("event_id").alias("id"), text.alias("text")), classify.RULES)
    return _round(out, "score")
