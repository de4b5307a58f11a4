"""Queries over the test tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..operators import classify, evaluate, metrics, resolve, totals
from ..sources.views import items, jobs, part_list, table, usage_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

JOBS = """WITH jobs AS (SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'needs_review' WHEN 'error' THEN 'failed'
 WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'pending' END AS status, value AS latency, value / 1000 AS confidence, CAST(user_id % 7 AS VARCHAR) AS doc_type,
 CASE WHEN user_id % 3 <> 0 THEN 'e' || CAST(user_id % 3 AS VARCHAR) END AS engine, user_id AS owner, props AS extracted, sha256(props) AS sha FROM events)"""
LOG = """WITH log AS (SELECT user_id % 20 AS caller, event_type AS connector, CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'success' END AS status, value AS units, ts AS started_at FROM events)"""
ITEMS = """WITH items AS (SELECT l_orderkey AS doc, l_linenumber AS line, l_quantity AS qty, l_extendedprice / l_quantity AS price, floor(l_tax * 100 + 0.5) AS rate, l_extendedprice AS total, l_partkey AS code, l_discount AS discount FROM lineitem)"""
METRICS = """count(*) AS total, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'needs_review') AS n_needs_review, count(*) FILTER (status = 'failed') AS n_failed,
 count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'processing') AS n_processing,
 round(quantile_cont(latency, 0.5) FILTER (status IN ('done', 'needs_review')), 6) AS p50, round(quantile_cont(latency, 0.95) FILTER (status IN ('done', 'needs_review')), 6) AS p95,
 round(avg(confidence) FILTER (status IN ('done', 'needs_review')), 6) AS avg_confidence"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- jobs and usage ----


@query(f"""{JOBS}, m AS (SELECT {METRICS} FROM jobs) SELECT *, round(n_done / total, 6) AS success_rate, round(n_failed / total, 6) AS failure_rate, round(n_needs_review / total, 6) AS review_rate, round(floor(total / 720 * 100 + 0.5) / 100, 6) AS per_hour FROM m""")
def ops_summary(spark, sf):
    return _round(metrics.summary(jobs(spark, sf), 720), "p50", "p95", "avg_confidence", "success_rate", "failure_rate", "review_rate", "per_hour")


@query(f"{JOBS} SELECT coalesce(doc_type, '_unknown') AS key, {METRICS} FROM jobs GROUP BY 1")
def ops_by_type(spark, sf):
    return _round(metrics.breakdown(jobs(spark, sf), F.col("doc_type"), "_unknown"), "p50", "p95", "avg_confidence")


@query(f"{JOBS} SELECT coalesce(engine, '_none') AS key, {METRICS} FROM jobs GROUP BY 1")
def ops_by_engine(spark, sf):
    return _round(metrics.breakdown(jobs(spark, sf), F.col("engine"), "_none"), "p50", "p95", "avg_confidence")


@query(f"""{JOBS}, j AS (SELECT *, CAST(floor(epoch(created_at) / 21600) * 21600 AS BIGINT) AS bucket FROM jobs), g AS (SELECT unnest(generate_series((SELECT min(bucket) FROM j), (SELECT max(bucket) FROM j), 21600)) AS bucket),
 a AS (SELECT bucket, count(*) AS n, count(*) FILTER (status = 'failed') AS failed, round(quantile_cont(latency, 0.95), 6) AS p95 FROM j GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n, coalesce(failed, 0) AS failed, p95 FROM g LEFT JOIN a USING (bucket)""")
def timeseries_filled(spark, sf):
    return _round(metrics.time_series(jobs(spark, sf), F.min("created_at"), F.max("created_at"), 360), "p95")


@query(f"{JOBS} SELECT 'k' AS field, count(*) FILTER (coalesce(extracted ->> '$.k', '') <> '') AS filled, count(*) FILTER (status IN ('done', 'needs_review')) AS total FROM jobs UNION ALL SELECT 'z.y', 0, count(*) FILTER (status IN ('done', 'needs_review')) FROM jobs")
def field_coverage(spark, sf):
    return metrics.coverage(jobs(spark, sf), ["k", "z.y"])


@query(f"{LOG} SELECT caller, connector, status, count(*) AS calls, round(coalesce(sum(units), 0), 4) AS units FROM log GROUP BY ALL")
def usage_rollup(spark, sf):
    return metrics.usage_rollup(usage_log(spark, sf), "caller", "connector", "status").withColumn("units", F.round("units", 4))


@query(f"{LOG} SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, connector, count(*) AS calls, round(coalesce(sum(units), 0), 4) AS units FROM log GROUP BY ALL")
def usage_daily(spark, sf):
    return metrics.usage_rollup(usage_log(spark, sf).withColumn("day", F.to_date("started_at").cast("string")), "day", "connector").withColumn("units", F.round("units", 4))


@query(f"""{LOG}, c AS (SELECT * FROM (VALUES ('purchase', true, 500), ('view', false, 500), ('click', true, NULL), ('error', true, 100)) AS v(connector, enabled, daily_cap)), d AS (SELECT max(CAST(started_at AS DATE)) AS day FROM log),
 u AS (SELECT caller, connector, sum(units) AS used FROM log, d WHERE CAST(started_at AS DATE) = day AND status = 'success' GROUP BY 1, 2),
 b AS (SELECT caller, 'purchase' AS connector, 50 * caller AS daily_budget, caller % 5 <> 0 AS budget_enabled FROM range(20) r(caller))
 SELECT caller, connector, round(used, 4) AS used, CAST(least(daily_cap, daily_budget) AS BIGINT) AS cap, CASE WHEN enabled IS NULL THEN 'unknown_connector' WHEN NOT enabled THEN 'connector_disabled' WHEN budget_enabled = false THEN 'consumer_disabled'
 WHEN least(daily_cap, daily_budget) IS NULL THEN 'no_cap' WHEN used >= least(daily_cap, daily_budget) THEN 'quota_exceeded' END AS reason FROM u LEFT JOIN c USING (connector) LEFT JOIN b USING (caller, connector)""")
def quota_check(spark, sf):
    log = usage_log(spark, sf)
    connectors = spark.createDataFrame([("purchase", True, 500), ("view", False, 500), ("click", True, None), ("error", True, 100)], "connector string, enabled boolean, daily_cap long")
    budgets = spark.range(20).select(F.col("id").alias("caller"), F.lit("purchase").alias("connector"), (50 * F.col("id")).alias("daily_budget"), (F.col("id") % 5 != 0).alias("budget_enabled"))
    day = F.broadcast(log.agg(F.max(F.to_date("started_at")).alias("today")))  # one row
    return metrics.quota(log.crossJoin(day), connectors, budgets, F.col("today")).withColumn("used", F.round("used", 4))


@query(f"""{JOBS}, j AS (SELECT j.id, d.id AS source_id, d.created_at FROM jobs j JOIN jobs d ON d.status = 'done' AND j.owner = d.owner AND j.sha = d.sha AND d.created_at < j.created_at AND d.created_at > j.created_at - INTERVAL 240 HOURS)
 SELECT id, arg_max(source_id, (created_at, source_id)) AS source_id FROM j GROUP BY 1""")
def ttl_dedup(spark, sf):
    return metrics.content_duplicates(jobs(spark, sf), 240)


@query(f"{JOBS} SELECT id, created_at FROM jobs WHERE status = 'pending' AND created_at < (SELECT max(created_at) FROM jobs) - INTERVAL 30 MINUTES ORDER BY created_at, id LIMIT 50")
def stale_pending(spark, sf):
    j = jobs(spark, sf)
    last = F.broadcast(j.agg(F.max("created_at").alias("last")))  # one row
    return metrics.stale(j.crossJoin(last), "pending", F.col("last") - F.expr("INTERVAL 30 MINUTES"), 50).select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"{JOBS} SELECT id, status, doc_type FROM jobs WHERE status IN ('failed', 'done') AND doc_type IN ('1', '2') ORDER BY created_at DESC, id LIMIT 40 OFFSET 20")
def list_page_topk(spark, sf):
    return jobs(spark, sf).where(F.col("status").isin("failed", "done") & F.col("doc_type").isin("1", "2")).orderBy(F.desc("created_at"), "id").offset(20).limit(40).select("id", "status", "doc_type")


@query(f"{JOBS} SELECT id, owner FROM jobs WHERE status IN ('done', 'failed') AND created_at < (SELECT max(created_at) FROM jobs) - INTERVAL 20 DAYS")
def retention_candidates(spark, sf):
    j = jobs(spark, sf)
    last = F.broadcast(j.agg(F.max("created_at").alias("last")))  # one row
    return j.where(F.col("status").isin("done", "failed")).crossJoin(last).where(F.col("created_at") < F.col("last") - F.expr("INTERVAL 20 DAYS")).select("id", "owner")


@query(f"{JOBS} SELECT doc_type, id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY created_at DESC, id DESC) = 1")
def latest_wins(spark, sf):
    return metrics.latest(jobs(spark, sf), ["doc_type"], ["created_at", "id"]).select("doc_type", "id", "status")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00012%' OR starts_with(CAST(c_custkey AS VARCHAR), '77')")
def quick_search(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name").ilike("%00012%") | F.col("c_custkey").cast("string").startswith("77")).select("c_custkey", "c_name")


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')) GROUP BY 1")
def tenant_scope(spark, sf):
    scope = table(spark, sf, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    nations = table(spark, sf, "nation").join(scope, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))


# ---- text ----


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dedup(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


@query(r"""WITH t AS (SELECT doc_id, trim(text) AS t, length(trim(text)) AS n, length(regexp_replace(trim(text), '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(trim(text), '[^А-Яа-яЁё]', '', 'g')) AS ru FROM documents)
 SELECT doc_id, round(CASE WHEN n < 50 THEN 0 ELSE least(1, CASE WHEN letters > 200 THEN 0.5 WHEN letters > 50 THEN 0.3 ELSE 0 END + CASE WHEN letters / n > 0.5 THEN 0.3 WHEN letters / n > 0.3 THEN 0.15 ELSE 0 END + CASE WHEN ru > 30 THEN 0.15 ELSE 0 END
 + CASE WHEN regexp_matches(t, '(?i)(ИНН|СЧЁТ|СЧЕТ|УПД|АКТ|НАКЛАДНАЯ|CMR|КПП|Итого|НДС)') THEN 0.1 ELSE 0 END) END::DOUBLE, 6) AS score FROM t""")
def pdf_text_quality(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(tx.pdf_text_quality(F.col("text")).cast("double"), 6).alias("score"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0 AND length(x) - length(regexp_replace(x, '[,\t;|]', '', 'g')) >= 2)) AS table_rows FROM documents")
def table_row_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.table_row_count(F.col("text")).cast("long").alias("table_rows"))


@query(r"SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x)) > 0 AND length(x) - length(regexp_replace(x, '[,\t;|]', '', 'g')) >= 2)) AS table_rows, table_rows > 400 AS deferred FROM documents")
def complex_deferral(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(tx.table_row_count(F.col("text")), F.lit(0)).alias("table_rows")).withColumn("deferred", F.col("table_rows") > 400)


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}', '[REDACTED]', 'g'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[REDACTED]', 'g')) AS sha FROM documents")
def pii_redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.redact(F.col("text"), ("phone_ru", "email")).cast("binary"), 256).alias("sha"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS sha FROM documents")
def control_strip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.strip_control(F.col("text")).cast("binary"), 256).alias("sha"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) <= 6000 THEN text ELSE text[1:4000] || chr(10) || '...' || chr(10) || right(text, 2000) END) AS sha FROM documents")
def head_tail_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.head_tail(F.col("text")).cast("binary"), 256).alias("sha"))


def _refused(pattern: str) -> str:
    return "coalesce(list_sum(list_transform(regexp_extract_all(text, '(?i)" + pattern.replace("'", "''") + "'), lambda x: length(x))), 0)"


@query(f"""WITH c AS (SELECT doc_id, length(text) AS n, ({' + '.join(_refused(p) for p in tx.REFUSAL_PATTERNS)}) AS hit FROM documents), d AS (SELECT *, CASE WHEN n > 0 THEN hit / n ELSE 0 END AS cover FROM c)
 SELECT doc_id, round(cover::DOUBLE, 2) AS coverage, cover > 0 AND (n < 800 OR cover >= 0.3) AS refusal FROM d""")
def ocr_refusal(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.round(tx.refusal_coverage(F.col("text")), 2).alias("coverage"), tx.is_refusal(F.col("text")).alias("refusal"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[А-Яа-яЁё]') THEN 'mixed' WHEN regexp_matches(text, '[А-Яа-яЁё]') THEN 'cyrillic' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' END AS script FROM documents")
def script_kind(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.script_kind(F.col("text")).alias("script"))


@query(r"""WITH t AS (SELECT doc_id, length(text) AS n, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: length(x) >= 3) AS w FROM documents)
 SELECT doc_id, round(CASE WHEN n < 50 OR len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[А-Яа-яЁё]'))) / len(w) END::DOUBLE, 6) AS ratio FROM t""")
def garbled_ratio(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(tx.garbled_ratio(F.col("text")), 6).alias("ratio"))


_HTML = "regexp_replace(html, '(?is)<img[^>]*>|<!--.*?-->', '', 'g')"
for _level in range(1, 7):
    _HTML = f"regexp_replace({_HTML}, '(?is)<h{_level}[^>]*>(.*?)</h{_level}>', chr(10) || '{'#' * _level} \\1' || chr(10), 'g')"
_HTML = f"regexp_replace(regexp_replace(regexp_replace({_HTML}, '(?is)<li[^>]*>(.*?)</li>', '- \\1' || chr(10), 'g'), '(?i)<br\\s*/?>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _name, _char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&amp;", "'&'")):
    _HTML = f"replace({_HTML}, '{_name}', {_char})"
_HTML = f"regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, {_HTML} AS markdown FROM pages")  # the pages have no tables and no other numeric entities
def html_to_markdown(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_to_markdown(F.col("html")).alias("markdown"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, starts_with(url, 'https://') AS secure FROM pages")
def url_shape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.startswith(F.col("url"), F.lit("https://")).alias("secure"))


@query("SELECT conv_id, turn, length(text) - length(replace(text, '{', '')) > 0 AND length(text) - length(replace(text, '}', '')) < length(text) - length(replace(text, '{', '')) AS truncated FROM conversations")
def truncated_json(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.truncated_json(F.col("text")).alias("truncated"))


RULES = [("licence", "license|copyright", 2.0), ("contact", "@|phone|call", 1.5), ("secret", "token|password|secret", 3.0), ("prose", r"\bthe\b", 0.5), ("prose_es", r"\bque\b", 0.5)]

_RULES = ", ".join(f"('{slug}', '{pattern}', {weight})" for slug, pattern, weight in RULES)


@query(f"""WITH d AS (SELECT doc_id AS id, text[1:4000] AS head FROM documents), h AS (SELECT id, slug, weight * CASE WHEN length(regexp_extract(head, '(?is)^(.*?)(?:' || p || ')', 1)) < 500 THEN 1.5 ELSE 1.0 END AS weight, length(regexp_extract(head, '(?i)' || p)) AS size FROM d, (VALUES {_RULES}) r(slug, p, weight) WHERE regexp_matches(head, '(?i)' || p)),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, size DESC, slug) AS rank FROM h) SELECT doc_id AS id, a.slug, round(CASE WHEN a.weight > 1 THEN 1 ELSE a.weight END, 6)::DOUBLE AS score, b.slug AS runner_up FROM documents LEFT JOIN k a ON a.id = doc_id AND a.rank = 1 LEFT JOIN k b ON b.id = doc_id AND b.rank = 2""")
def keyword_classify(spark, sf):
    return classify.classify(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), RULES)


# ---- totals ----


@query(f"{ITEMS}, s AS (SELECT doc, sum(total) AS summed FROM items GROUP BY 1), h AS (SELECT o_orderkey AS doc, o_totalprice AS stated FROM orders) SELECT doc, stated, round(summed, 2) AS summed, round(CASE WHEN abs(summed - stated) >= 1 THEN summed ELSE stated END, 2) AS total, round(CASE WHEN abs(summed - stated) >= 1 THEN summed - stated END, 2) AS delta FROM h LEFT JOIN s USING (doc)")
def recompute_totals(spark, sf):
    headers = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_totalprice").alias("stated"))
    return totals.recompute(headers, items(spark, sf)).withColumns({c: F.round(c, 2) for c in ("summed", "total", "delta")})


@query(f"{ITEMS}, n AS (SELECT doc, rate, count(*) AS n FROM items GROUP BY 1, 2) SELECT doc, arg_max(rate, (n, rate)) AS rate FROM n GROUP BY 1")
def modal_rate(spark, sf):
    return totals.modal_rate(items(spark, sf))


@query(f"{ITEMS} SELECT doc, line, round(abs(qty * price * (1 - discount) - total), 4) AS off FROM items WHERE abs(qty * price * (1 - discount) - total) > 0.025 * abs(total)")
def line_consistency(spark, sf):
    t = items(spark, sf).withColumn("price", F.col("price") * (1 - F.col("discount")))
    return totals.inconsistent_lines(t, 0.025).withColumn("off", F.round("off", 4))


@query(f"{ITEMS}, d AS (SELECT doc, sum(total) AS total, sum(total * rate / 105) AS vat, max(rate) AS rate FROM items GROUP BY 1) SELECT doc, round(vat, 4) AS vat, round(total * rate / (100 + rate), 4) AS due FROM d WHERE abs(vat - total * rate / (100 + rate)) > greatest(1, 0.005 * total)")
def vat_consistency(spark, sf):
    d = items(spark, sf).groupBy("doc").agg(F.sum("total").alias("total"), F.sum(F.col("total") * F.col("rate") / 105).alias("vat"), F.max("rate").alias("rate"))
    return totals.vat_issues(d).select("doc", F.round("vat", 4).alias("vat"), F.round("due", 4).alias("due"))


@query(f"{ITEMS} SELECT doc, min(line) AS line, code % 50 AS code FROM items GROUP BY doc, code % 50")
def item_dedup(spark, sf):
    return totals.first_of_item(items(spark, sf).select("doc", "line", (F.col("code") % 50).alias("code")), ["code"])


@query(f"{ITEMS} SELECT doc, round(sum(floor(qty * 0.3 * 100 + 0.5) / 100 + floor(price * 0.001 * 100 + 0.5) / 100), 2) AS cost FROM items GROUP BY 1")
def cost_breakdown(spark, sf):
    line = tx.js_round(F.col("qty") * 0.3, 2) + tx.js_round(F.col("price") * 0.001, 2)
    return items(spark, sf).groupBy("doc").agg(F.round(F.sum(line), 2).alias("cost"))


# ---- resolution ----


@query("WITH v AS (SELECT s_suppkey AS id, s_suppkey * 2 AS a, s_suppkey + 1 AS b FROM supplier) SELECT id, CASE WHEN a <= (SELECT max(p_partkey) FROM part) THEN a ELSE b END AS entry_id, 'exact' AS method FROM v")
def entity_link_exact(spark, sf):
    s = table(spark, sf, "supplier")
    pairs = F.array(F.struct(F.lit("code").alias("field"), F.lit(0).alias("place"), (F.col("s_suppkey") * 2).cast("string").alias("value")), F.struct(F.lit("other").alias("field"), F.lit(1).alias("place"), (F.col("s_suppkey") + 1).cast("string").alias("value")))
    return resolve.exact_links(s.select(F.col("s_suppkey").alias("id"), F.explode(pairs).alias("p")).select("id", "p.*"), part_list(spark, sf))


GRAMS = """g AS (SELECT k, nm, unnest(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(nm), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2]))))) AS gram FROM ({src}) t)"""


def _similar(left: str) -> str:
    """SQL of all pairs of distinct names (left: a subquery of them) and parts' names that are similar."""
    names = "SELECT DISTINCT p_name AS k, p_name AS nm FROM part"
    return "a AS (WITH " + GRAMS.format(src=left) + " SELECT * FROM g), b AS (WITH " + GRAMS.format(src=names) + """ SELECT * FROM g), na AS (SELECT k, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT k, count(*) AS m FROM b GROUP BY 1),
 s AS (SELECT a.k AS nm, b.k AS other, count(*) AS c FROM a JOIN b USING (gram) GROUP BY 1, 2), t AS (SELECT s.nm, other, c / (n + m - c) AS score FROM s JOIN na ON na.k = s.nm JOIN nb ON nb.k = other WHERE c / (n + m - c) >= 0.3),
 e AS (SELECT p_name AS other, p_partkey AS entry_id FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) <= 5), r AS (SELECT nm, entry_id, score, row_number() OVER (PARTITION BY nm ORDER BY score DESC, other, entry_id) AS rank FROM t JOIN e USING (other) QUALIFY rank <= 5)"""


FUZZY = "WITH " + _similar("SELECT DISTINCT p_name AS k, p_name AS nm FROM part") + " SELECT p_partkey AS id, entry_id, round(score, 6) AS score, rank FROM part JOIN r ON nm = p_name"


@query(FUZZY)
def fuzzy_match(spark, sf):
    entries = part_list(spark, sf)
    return _round(resolve.fuzzy_match(entries.select(F.col("entry_id").alias("id"), F.col("display_name").alias("name")), entries), "score")


@query(FUZZY)
def fuzzy_match_all(spark, sf):
    return fuzzy_match(spark, sf)


@query("WITH " + _similar("SELECT DISTINCT p_name || ' x' AS k, p_name || ' x' AS nm FROM part") + """, f AS (SELECT p_name AS nm, min(p_partkey) AS entry_id FROM part GROUP BY 1), g AS (SELECT * FROM r WHERE rank = 1)
 SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN f.entry_id ELSE g.entry_id END AS entry_id, CASE p_partkey % 3 WHEN 0 THEN 'exact_code' WHEN 1 THEN 'exact_name' ELSE CASE WHEN g.entry_id IS NULL THEN 'not_found' ELSE 'fuzzy' END END AS method, round(CASE WHEN p_partkey % 3 < 2 THEN 1.0 ELSE score END::DOUBLE, 6) AS score FROM part LEFT JOIN f ON f.nm = p_name LEFT JOIN g ON g.nm = p_name || ' x'""")
def item_match(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).alias("code"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" x"))).alias("name"))
    return _round(resolve.match_items(p, part_list(spark, sf)), "score")


@query("SELECT coalesce(a.c_custkey, b.s_suppkey * 3) AS external_id, coalesce(s_name, c_name) AS name, b.s_suppkey IS NOT NULL AS is_active FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey * 3")
def list_sync(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("external_id"), F.col("c_name").alias("name"), F.lit(True).alias("is_active"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("external_id"), F.col("s_name").alias("name"))
    return resolve.sync_list(old, new)


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, p_partkey)) AS p_partkey FROM part GROUP BY 1")
def distinct_on_best(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"))


@query("SELECT p_partkey, coalesce(nullif(CASE levenshtein(p_brand, 'Brand#12') > 3 WHEN true THEN 4 ELSE levenshtein(p_brand, 'Brand#12') END, -1), 4)::INT AS distance FROM part")
def edit_distance(spark, sf):
    d = F.levenshtein("p_brand", F.lit("Brand#12"), 3)
    return table(spark, sf, "part").select("p_partkey", F.when(d < 0, 4).otherwise(d).alias("distance"))


@query("""WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '7') AS d FROM customer) SELECT c_custkey, (((2 * d[1]::INT + 4 * d[2]::INT + 10 * d[3]::INT + 3 * d[4]::INT + 5 * d[5]::INT + 9 * d[6]::INT + 4 * d[7]::INT + 6 * d[8]::INT + 8 * d[9]::INT) % 11) % 10) = d[10]::INT AS valid FROM c""")
def inn_checksum(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", vl.inn_valid(F.lpad(F.col("c_custkey").cast("string"), 10, "7")).alias("valid"))


# ---- evaluation ----


@query("SELECT path, count(*) AS n, count(*) FILTER (o = 'match') AS matched, count(*) FILTER (o = 'missing') AS missing, round(count(*) FILTER (o = 'match') / nullif(count(*) FILTER (o IN ('match', 'mismatch')), 0), 6) AS accuracy, round(count(*) FILTER (o IN ('match', 'mismatch')) / count(*), 6) AS coverage FROM (SELECT path, CASE WHEN e IS NULL THEN 'match' WHEN a IS NULL THEN 'missing' WHEN e = a THEN 'match' ELSE 'mismatch' END AS o FROM (SELECT 'quality' AS path, quality AS e, toxic AS a FROM labels UNION ALL SELECT 'toxic', toxic, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE toxic END FROM labels) t) u GROUP BY 1")
def eval_field_metrics(spark, sf):
    rows = table(spark, sf, "labels")
    pairs = F.array(F.struct(F.lit("quality").alias("path"), F.lit("integer").alias("kind"), F.col("quality").cast("string").alias("expected"), F.col("toxic").cast("string").alias("actual")), F.struct(F.lit("toxic").alias("path"), F.lit("integer").alias("kind"), F.col("toxic").cast("string").alias("expected"), F.when(F.col("doc_id") % 4 != 0, F.col("toxic").cast("string")).alias("actual")))
    return _round(evaluate.field_metrics(rows.select(F.explode(pairs).alias("p")).select("p.*")), "accuracy", "coverage")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def nearest_rank_percentile(spark, sf):
    return metrics.exact_percentiles(table(spark, sf, "events").where("event_type IS NOT NULL"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, nearest=True)
