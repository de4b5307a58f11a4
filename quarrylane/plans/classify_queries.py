"""Document types: names, file names, corrections, arbitration, page segments, job tables. Inputs are made from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as ck
from ..functions import records as rc
from ..functions import slugs as sl
from ..operators import costs, pages, queue
from ..sources.views import jobs, table
from .extract_queries import pick, sql_pick
from .queries import JOBS, query

TYPES = ("TTN", "ttn", "services_act", "AKT", "factInvoice", "tax_invoice", "invoice", "CMR")


@query(f"""SELECT event_id, {sql_pick('event_id', ('ttn', 'ttn', 'services_act', 'services_act', 'tax_invoice', 'tax_invoice', 'invoice', 'cmr'))} AS outside, {sql_pick('event_id', ('TTN', 'TTN', 'AKT', 'AKT', 'factInvoice', 'factInvoice', 'invoice', 'CMR'))} AS inside,
 {sql_pick('event_id', ('TTN,ttn', 'ttn,TTN', 'services_act,AKT', 'AKT,services_act', 'factInvoice,tax_invoice', 'tax_invoice,factInvoice', 'invoice', 'CMR,cmr'))} AS forms FROM events""")
def slug_forms(spark, sf):
    x = pick(F.col("event_id"), TYPES)
    return table(spark, sf, "events").select("event_id", sl.outside(x).alias("outside"), sl.inside(x).alias("inside"), F.array_join(sl.forms(x), ",").alias("forms"))


@query("SELECT event_id FROM events WHERE event_id % 8 IN (2, 3) ORDER BY ts DESC, event_id LIMIT 50")
def list_by_type(spark, sf):
    e = table(spark, sf, "events")
    return e.where(sl.is_type(pick(F.col("event_id"), TYPES), "AKT")).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id")


@query(f"""{JOBS}, t AS (SELECT *, [{', '.join(f"'{t}'" for t in TYPES)}][id % 8 + 1] AS slug FROM jobs), d AS (SELECT * FROM (VALUES ('TTN', 'transport'), ('AKT', 'service'), ('invoice', 'money')) v(slug, tier))
 SELECT coalesce(d.tier, '_untyped') AS key, count(*) AS total, count(*) FILTER (status = 'done') AS n_done FROM t LEFT JOIN d ON d.slug = CASE t.slug WHEN 'ttn' THEN 'TTN' WHEN 'services_act' THEN 'AKT' WHEN 'tax_invoice' THEN 'factInvoice' ELSE t.slug END GROUP BY 1""")
def breakdown_by_tier(spark, sf):
    tiers = spark.createDataFrame([("TTN", "transport"), ("AKT", "service"), ("invoice", "money")], "slug string, tier string")
    j = jobs(spark, sf).withColumn("slug", sl.inside(pick(F.col("id"), TYPES))).join(F.broadcast(tiers), "slug", "left")  # a row for each type
    return j.groupBy(F.coalesce("tier", F.lit("_untyped")).alias("key")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("n_done"))


FILES = ("C:\\\\x\\\\MBL 123.pdf", "docs/ГТД_7.pdf", "vat-invoice.xml", "акт взвешивания.doc", "PI-2044.pdf", "commercial_invoice 5.xls", "packing list.pdf", "ТТН 8.jpg", "awb-1.png", "act_3.pdf", "Счёт 9.pdf", "conformity.pdf", "Contract.docx", "заявка.txt", "able.pdf", None)
MARKS = ("bill_of_lading", "customs_declaration", "factInvoice", "weighing_act", "proforma_invoice", "commercial_invoice", "packing_list", "TTN", "awb", "AKT", "invoice", "eac_conformity_certificate", "contract", "transport_request", None, None)


@query(f"SELECT event_id, {sql_pick('event_id', MARKS)} AS mark FROM events")
def file_name_mark(spark, sf):
    return table(spark, sf, "events").select("event_id", sl.file_mark(pick(F.col("event_id"), [f and f.replace("\\\\", "\\") for f in FILES])).alias("mark"))


@query("""WITH t AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'invoice' ELSE 'TTN' END AS best, CASE WHEN event_id % 4 > 0 THEN (event_id % 9)::DOUBLE END AS w, event_id % 5 = 0 AS title, CASE WHEN event_id % 3 > 0 THEN 'invoice' END AS mark, CASE WHEN event_id % 7 = 0 THEN 2.0 END AS mw FROM events),
 o AS (SELECT *, coalesce(mw + 1.0, 5.5) AS own FROM t) SELECT id, CASE WHEN mark IS NULL OR best = mark OR (best IS NOT NULL AND title) THEN best WHEN best IS NULL OR own >= w THEN mark ELSE best END AS slug,
 (CASE WHEN mark IS NULL THEN w WHEN best = mark THEN w + 1 WHEN best IS NOT NULL AND title THEN w WHEN best IS NULL OR own >= w THEN own ELSE w END)::DOUBLE AS weight FROM o""")
def file_name_fusion(spark, sf):
    k = F.col("event_id")
    best = F.when(k % 4 == 1, "invoice").when(k % 4 > 1, "TTN")
    fused = sl.fuse_file_mark(best, F.when(k % 4 > 0, (k % 9).cast("double")), k % 5 == 0, F.when(k % 3 > 0, "invoice"), F.when(k % 7 == 0, 2.0))
    return table(spark, sf, "events").select(k.alias("id"), fused.alias("f")).select("id", "f.*")


ANSWERS = ("invoice", "TTN", "unknown", " ", "nonsense", "TTN")


@query(f"""WITH t AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'TTN' END AS prior, value / 1000 AS c, trim({sql_pick('event_id', ANSWERS)}) AS said, event_id % 6 = 5 AS failed FROM events)
 SELECT id, CASE WHEN failed OR said = 'nonsense' THEN prior WHEN said IN ('', 'unknown') THEN CASE WHEN c >= 0.5 THEN prior END ELSE said END AS type,
 round((CASE WHEN failed OR said = 'nonsense' THEN CASE WHEN prior IS NULL THEN 0 ELSE floor(c * 1000 + 0.5) / 1000 END WHEN said IN ('', 'unknown') THEN CASE WHEN prior IS NOT NULL AND c >= 0.5 THEN floor(c * 1000 + 0.5) / 1000 ELSE 0 END WHEN prior = said THEN floor(greatest(0.9, c) * 1000 + 0.5) / 1000 WHEN prior IS NULL THEN 0.7 ELSE 0.5 END)::DOUBLE, 6) AS confidence,
 CASE WHEN failed OR said = 'nonsense' OR (said IN ('', 'unknown') AND prior IS NOT NULL AND c >= 0.5) THEN 'fallback' ELSE 'llm' END AS method FROM t""")
def arbitration(spark, sf):
    k, said = F.col("event_id"), pick(F.col("event_id"), ANSWERS)
    out = sl.arbitrate(F.when(k % 3 == 0, "invoice").when(k % 3 == 1, "TTN"), F.col("value") / 1000, said, k % 6 == 5, said != "nonsense")
    return table(spark, sf, "events").select(k.alias("id"), out.alias("o")).select("id", "o.type", F.round("o.confidence", 6).alias("confidence"), "o.method")


@query(f"""SELECT event_id, {sql_pick('event_id', ('invoice', 'ttn', None, 'packing_list', None))} AS slug, {sql_pick('event_id', ('letter', 'other', 'id_document', 'other', 'not_a_document'))} AS broad, {sql_pick('event_id', ('Письмо', 'Прочее', 'Удостоверение личности', 'Прочее', 'Не документ'))} AS label,
 {sql_pick('event_id', ('ttn', None, None, 'ttn', None))} AS mapped, {sql_pick('event_id', ('mapped', 'foreign_document', 'foreign_document', 'mapped', 'not_a_document'))} AS verdict FROM events""")
def model_slugs(spark, sf):
    k = F.col("event_id")
    broad, candidate = pick(k, (" Letter!", None, "id_document", "what", "not_a_document")), pick(k, ("TTN.", "unknown", "ttn", " ttn", "zzz"))
    v = sl.deep_verdict(broad, candidate, candidate.rlike("(?i)ttn"))
    return table(spark, sf, "events").select("event_id", sl.clean_slug(pick(k, ("`Invoice` is it", " ttn\nmaybe", "unknown", "packing_list", "  "))).alias("slug"), v["broad"].alias("broad"), sl.broad_label(broad).alias("label"), v["slug"].alias("mapped"), v["verdict"].alias("verdict"))


SPEC_TEXTS = ("Specification No 5", "Specification, unit price 7", "Gross weight 10, 5 pallets", "Net weight 7, total amount 5", "plain")


@query(f"""SELECT event_id, {sql_pick('event_id', ('contract_specification', 'commercial_invoice', 'commercial_invoice', 'commercial_invoice', 'commercial_invoice'))} AS spec, {sql_pick('event_id', ('commercial_invoice', 'commercial_invoice', 'packing_list', 'commercial_invoice', 'commercial_invoice'))} AS weight FROM events""")
def type_corrections(spark, sf):
    text, slug = pick(F.col("event_id"), SPEC_TEXTS), F.lit("commercial_invoice")
    return table(spark, sf, "events").select("event_id", sl.correct_specification(slug, text).alias("spec"), sl.correct_weight_page(slug, text).alias("weight"))


@query("""SELECT p_brand AS brand, string_agg(CASE WHEN p_partkey % 3 = 0 THEN p_type || ' — ' || p_name WHEN p_partkey % 3 = 1 THEN p_type || ' — ' || left(p_name || ' of ' || p_brand, 80) ELSE p_type END, chr(10) ORDER BY p_partkey) AS catalogue FROM part GROUP BY 1""")
def catalogue_text(spark, sf):
    """The catalogue of each brand's parts, as an organisation has one of its types."""
    k = F.col("p_partkey")
    line = sl.catalogue_line(F.col("p_type"), F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_name"))), F.when(k % 3 == 1, F.concat(F.col("p_name"), F.lit("  of\n "), F.col("p_brand"))))
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("r"))
    return rows.select("brand", F.array_join(F.transform("r", lambda r: r["line"]), "\n").alias("catalogue"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 > 0 THEN CASE WHEN event_id % 5 > 0 THEN 'text,cloud,local' ELSE 'cloud,local' END ELSE CASE WHEN event_id % 5 > 0 THEN 'text,local' ELSE 'local' END END AS chain FROM events""")
def engine_chain(spark, sf):
    k = F.col("event_id")
    one = lambda n, ok: F.struct(F.lit(n).alias("name"), ok.alias("available"), F.lit(True).alias("supports"))
    engines = F.array(one("text", k % 5 > 0), one("local", F.lit(True)), one("cloud", F.lit(True)), one("off", F.lit(False)))
    return table(spark, sf, "events").select("event_id", F.array_join(sl.engine_chain(engines, ("cloud",), k % 3 == 0, k % 2 == 0, ("local",), True), ",").alias("chain"))


# ---- pages ----

HEADS = ("INVOICE NO: A%s text", "Packing list for %s", "MRN 25LV%s00000000000 Export accompanying", "more of the same text %s", "Invoice number A%s goes on", "Passport %s", "plain page %s")


@query(f"""SELECT event_id, {sql_pick('event_id', ('commercial_invoice', 'packing_list', 'customs_export_ead', None, 'commercial_invoice', 'driver_passport', None))} AS start, {sql_pick('event_id', ('A%s', None, None, None, 'A%s', None, None))} IS NOT NULL AS has_number, CASE WHEN event_id % 7 = 2 THEN '25LV' || lpad((event_id % 1000)::VARCHAR, 3, '0') || '00000000000' END AS mrn FROM events""")
def page_starts(spark, sf):
    k = F.col("event_id")
    text = F.replace(pick(k, HEADS), F.lit("%s"), F.lpad((k % 1000).cast("string"), 3, "0"))
    h = pages.page_heads(table(spark, sf, "events").select("event_id", text.alias("text")))
    return h.select("event_id", "start", F.col("identity.invoice_no").isNotNull().alias("has_number"), F.col("identity.mrn").alias("mrn"))


def _page_table(spark, sf):
    """Pages of files of up to six pages, with types, confidences and headings from keys."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    text = F.concat(F.when(k % 11 == 0, F.concat(F.lit("INVOICE NO: A"), F.floor(k / 22))).otherwise("page"), F.when(k % 5 == 0, "").otherwise(F.lit(" filler text" * 12)))
    t = e.select(F.floor(k / 6).alias("file"), (k % 6 + 1).cast("int").alias("page"), text.alias("text"), F.when(k % 7 > 0, F.when(k % 6 < 3, "invoice").otherwise("TTN")).alias("type"), (F.col("user_id") % 10 / 10).alias("confidence"))
    return pages.page_heads(t).withColumn("n_chars", F.length(F.trim("text")))


def _fold_sql(given: str = "NULL") -> str:
    """Segments (s) of the page table by a recursive fold over pages; ``given``: types that override weak pages."""
    return f"""WITH RECURSIVE e AS (SELECT event_id AS k, event_id // 6 AS file, event_id % 6 + 1 AS page, CASE WHEN event_id % 11 = 0 THEN 'INVOICE NO: A' || (event_id // 22) ELSE 'page' END || CASE WHEN event_id % 5 = 0 THEN '' ELSE repeat(' filler text', 12) END AS text,
  CASE WHEN event_id % 7 > 0 THEN CASE WHEN event_id % 6 < 3 THEN 'invoice' ELSE 'TTN' END END AS type, (user_id % 10 / 10)::DOUBLE AS confidence, CASE WHEN event_id % 11 = 0 THEN 'commercial_invoice' END AS start, CASE WHEN event_id % 11 = 0 THEN 'A' || (event_id // 22) END AS inv FROM events),
 g AS (SELECT *, length(trim(text)) AS n, CASE WHEN page > 1 AND (type IS NULL OR confidence < 0.5) THEN {given} END AS given FROM e),
 p AS (SELECT file, page, n, text, inv, given IS NOT NULL AS forced, coalesce(given, type) AS type, coalesce(given, start) AS start, CASE WHEN given IS NULL THEN confidence ELSE greatest(confidence, 0.6) END AS confidence FROM g),
 r AS (SELECT file, page, 1 AS segment, start IS NOT NULL AS bounded, coalesce(start, type) AS type, page AS first, CASE WHEN start IS NULL THEN confidence ELSE greatest(confidence, 0.6) END AS confidence, inv FROM p WHERE page = 1
  UNION ALL SELECT file, page, segment + opens::INT, CASE WHEN opens THEN heads ELSE bounded END, CASE WHEN NOT opens THEN type WHEN heads THEN p_start ELSE p_type END, CASE WHEN opens THEN page ELSE first END,
   CASE WHEN opens THEN CASE WHEN heads THEN greatest(c, 0.6) ELSE c END ELSE (confidence * (page - first) + CASE WHEN weak THEN confidence ELSE c END) / (page - first + 1) END, CASE WHEN opens THEN p_inv ELSE coalesce(inv, p_inv) END
   FROM (SELECT *, heads OR coalesce(p_inv <> inv, false) OR NOT (weak OR p_type IS NULL OR coalesce(p_type = type, false) OR bounded) AS opens
    FROM (SELECT r.file, p.page, r.segment, r.bounded, r.type, r.first, r.confidence, r.inv, p.type AS p_type, p.start AS p_start, p.inv AS p_inv, p.confidence AS c, p.n < 100 OR p.confidence < 0.4 AS weak,
     p.start IS NOT NULL AND (p.forced OR NOT (p.start = 'commercial_invoice' AND coalesce(p.inv = r.inv, false))) AS heads FROM r JOIN p ON p.file = r.file AND p.page = r.page + 1) x) y),
 s AS (SELECT file, segment, arg_max(type, page) AS type, min(first)::INT AS first, max(page)::INT AS last, floor(arg_max(confidence, page) * 1000 + 0.5) / 1000 AS confidence, bool_or(bounded) AS bounded FROM r GROUP BY 1, 2),
 d AS (SELECT file, count(*) >= 2 AND count(*) FILTER (bounded OR (type IS NOT NULL AND confidence >= 0.5)) >= 1 AS several FROM s GROUP BY 1)"""


_SPAN = "CASE WHEN first = last THEN first::VARCHAR ELSE first || '-' || last END AS pages"


@query(f"{_fold_sql()} SELECT *, {_SPAN} FROM s")
def page_segments(spark, sf):
    return pages.split_pages(_page_table(spark, sf)).drop("identity")


@query(f"{_fold_sql()} SELECT * FROM d")
def several_documents(spark, sf):
    return pages.several_documents(pages.split_pages(_page_table(spark, sf)))


@query(f"""{_fold_sql("CASE WHEN n < 120 THEN CASE WHEN k % 4 = 0 THEN 'vehicle_registration' END ELSE CASE WHEN k % 3 = 0 THEN 'packing_list' WHEN k % 4 = 0 THEN 'vehicle_registration' END END")}, t AS (SELECT s.file, segment, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS text FROM s JOIN p ON p.file = s.file AND page BETWEEN first AND last GROUP BY 1, 2)
 SELECT s.file, s.segment, type, {_SPAN}, confidence, t.text FROM s JOIN d USING (file) JOIN t ON t.file = s.file AND t.segment = s.segment WHERE several AND type IS NOT NULL""")
def composite_documents(spark, sf):
    t, k = _page_table(spark, sf), F.col("file") * 6 + F.col("page") - 1
    answer = lambda n, slug: t.where(k % n == 0).select("file", "page", F.lit(slug).alias("type"))
    out = pages.run_documents(t, answer(4, "vehicle_registration"), answer(3, "packing_list"))
    return out.select("file", "segment", "type", "pages", "confidence", F.md5(F.col("text").cast("binary")).alias("text"))


# ---- sources ----

URLS = ("https://a.example/x", "HTTP://B.example", "ftp://a.example/f", "https://c.example/x", "not a url")
ADDRESSES = ("10.1.2.3", "8.8.8.8", "172.20.0.1", "172.40.0.1", "100.64.0.1", "192.168.1.1", "169.254.1.1", "::1", "2001:db8::5", "fe80::1", "::ffff:127.0.0.1", "999.1.1.1", "224.0.0.1")


@query(f"SELECT event_id, {sql_pick('event_id', (None, None, 'scheme', 'host', 'malformed'))} AS problem, {sql_pick('event_id', (True, False, True, False, True, True, True, True, False, True, True, True, True))} AS private FROM events")
def url_and_address(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", ck.url_problem(pick(k, URLS), ("a.example", "b.example")).alias("problem"), ck.private_ip(pick(k, ADDRESSES)).alias("private"))


@query("SELECT page_id, 2 + (page_id % 2)::INT AS parts FROM pages")
def marked_pages(spark, sf):
    k = F.col("page_id")
    text = F.concat(F.when(k % 2 == 1, "head\n").otherwise(""), F.lit("Page 1\nfoo\n стр. № 2\nbar"))
    return table(spark, sf, "pages").select("page_id", F.size(ck.split_pages(text)).alias("parts"))


# ---- job tables ----


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 100000000, s_name FROM supplier")
def insert_if_absent(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier")
    new = s.select((F.col("s_suppkey") + 100_000_000).alias("id"), F.col("s_name").alias("name"))
    return queue.insert_if_absent(c, new.unionByName(c.where("id % 2 = 0").withColumn("name", F.lit("other"))), ["id"])


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN event_id ELSE first_value(event_id) OVER (PARTITION BY user_id % 3, event_id % 5 = 0, event_id % 50 ORDER BY ts, event_id) END AS job FROM events""")
def idempotency_replay(spark, sf):
    k = F.col("event_id")
    r = table(spark, sf, "events").select(k.alias("id"), (F.col("user_id") % 3).alias("tenant"), F.when(k % 5 > 0, k % 50).alias("key"), F.col("ts").alias("at"))
    return queue.replay(r).select("id", "job")


@query("""WITH t AS (SELECT user_id AS job, bool_or(event_type = 'purchase') AS ok, count(*) AS n, max(ts) AS last FROM events GROUP BY 1) SELECT job, CASE WHEN ok THEN 'done' WHEN n >= 8 THEN 'failed' ELSE 'waiting' END AS state, n, CASE WHEN NOT ok AND n < 8 THEN CAST(floor(epoch(last)) + 5 * 2 ** (n - 1) AS BIGINT) END AS due FROM t""")
def work_queue(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("ok"))
    return queue.queue_state(e, attempts=8).select("job", "state", "n", F.unix_timestamp("due").alias("due"))


@query("SELECT event_id AS id, coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 6 END, 0) + 1 AS reclaims, coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 6 END, 0) >= 3 AS stalled, CASE WHEN coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 6 END, 0) >= 3 THEN 'needs_review' ELSE 'pending' END AS status FROM events")
def reclaim_stuck(spark, sf):
    k = F.col("event_id")
    return queue.reclaim(table(spark, sf, "events").select(k.alias("id"), F.when(k % 3 > 0, k % 6).alias("reclaims")))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'matched' WHEN p_partkey % 3 = 1 THEN 'review' ELSE 'draft' END AS action, CASE WHEN p_partkey % 2 > 0 AND p_partkey % 3 = 2 THEN p_name END AS draft_name FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 > 0""")
def not_found_policy(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.when(k % 2 == 0, k).alias("entry_id"))
    return queue.not_found(rows, pick(F.col("id"), ("ignore", "flag", "create"))).select("id", "action", "draft_name")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE n_name END AS country, CASE WHEN s_suppkey % 2 = 0 THEN '' WHEN n_name IS NULL THEN '' ELSE 'country' END AS enriched FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20""")
def registry_enrichment(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("code"), F.when(F.col("s_suppkey") % 2 == 0, "own").alias("country"))
    n = table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("country"))
    return queue.enrich(s, n, "code", ["country"]).select("s_suppkey", "country", F.array_join("enriched", ",").alias("enriched"))


@query(f"""{JOBS} SELECT id, CASE WHEN status IN ('done', 'needs_review') THEN CASE WHEN id % 2 = 0 THEN 'a,late' ELSE 'late' END WHEN id % 2 = 0 THEN 'a' END AS issues, coalesce(id % 2 = 0, false) AS had FROM jobs""")
def append_issue(spark, sf):
    issues = F.when(F.col("id") % 2 == 0, F.array(F.lit("a")))
    return jobs(spark, sf).select("id", F.array_join(rc.append_issue(issues, F.lit("late"), F.col("status")), ",").alias("issues"), F.coalesce(F.json_array_length(F.to_json(issues)) > 0, F.lit(False)).alias("had"))


@query("""SELECT DISTINCT n_regionkey AS region, (SELECT n_name FROM nation m WHERE m.n_regionkey = n.n_regionkey ORDER BY n_name, n_nationkey LIMIT 1) AS first FROM nation n WHERE n_nationkey % 5 = 0 OR n_regionkey = 1""")
def first_of_scope(spark, sf):
    n = table(spark, sf, "nation")
    seen = n.where((F.col("n_nationkey") % 5 == 0) | (F.col("n_regionkey") == 1)).select("n_regionkey").distinct()
    return queue.first_by(n, ["n_regionkey"], ["n_name", "n_nationkey"]).join(seen, "n_regionkey", "left_semi").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("first"))


@query("SELECT count(*) AS n FROM customer WHERE (c_nationkey % 3 = 0 OR c_nationkey = 7) AND lower(c_mktsegment) = lower('bUILDING')")
def count_own_or_global(spark, sf):
    scope = F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey"))  # null: everybody's
    return table(spark, sf, "customer").where((scope.isNull() | (scope == 7)) & (F.lower("c_mktsegment") == "bUILDING".lower())).agg(F.count("*").alias("n"))


@query("SELECT event_id, round(floor((event_id % 1000 / 1000 * 0.5 + user_id % 500 / 1000 * 1.5) * 100 + 0.5) / 100, 2)::DOUBLE AS cost FROM events")
def simple_cost(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(costs.simple_cost(F.col("event_id") % 1000, F.col("user_id") % 500, 0.5, 1.5), 2).alias("cost"))
