"""Queries of jobs after extraction: rules of scopes, lists, review, inboxes, deliveries, second extractions, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as rc
from ..functions import text as tx
from ..operators import classify, lifecycle, metrics, resolve, tables, totals
from ..operators.layout import spread
from ..sources.views import items, jobs, table
from .extract_queries import BLEED, pick, sql_pick
from .queries import ITEMS, JOBS, _round, query

_TITLES = ("Универсальный передаточный документ", "Документ УПД", "акт сдачи", "Счёт на оплату", "Счет", "Путевой лист", "plain", "Транспортная накладная и счёт-фактура", "заявка на перевозку, форма ПЛ-1")
_FILES = ("scan.pdf", "акт.pdf", "scan.pdf", "contract_1.pdf", "scan.pdf", "scan.pdf", "scan.pdf")
_FILE_TYPES = (None, "AKT", None, "contract", None, None, None)
# The built-in rules that these texts can meet, as DuckDB can say them: it has no look-behind, so what stands before is outside the first group.
_RULES_SQL = (
    ("UPD", r"(?:^|[^а-яёa-z])(упд)(?:$|[^а-яёa-z])", 1.0), ("UPD", r"(универсальный\s+передаточный\s+документ)", 1.0), ("TTN", r"(транспортная\s+накладная)", 1.0), ("factInvoice", r"(сч[её]т-фактура)", 1.0),
    ("AKT", r"(?:^|[^а-яёa-z])(акт\s+(?:оказанных|выполненных|сдачи))", 0.95), ("invoice", r"(сч[её]т\s+на\s+оплату|сч[её]т\s+№)", 0.9), ("invoice", r"(сч[её]т)", 0.6), ("waybill", r"(путевой\s+лист|форма\s+4-С|форма\s+4-П|форма\s+ПЛ-1)", 1.0),
    ("transport_request", r"(заявка\s+(?:№|на\s+перевозку))", 1.0),
)
_BUILTIN = ", ".join(f"('{s}', '{p}', {w}, {i})" for i, (s, p, w) in enumerate(_RULES_SQL))


@query(f"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[a-z]+') AS w FROM benchmark),
 t AS (SELECT CASE WHEN item_id % 8 > 0 THEN 'src' || item_id % 20 END AS scope, 'b' || item_id AS slug, unnest([w[1] || '\\s+' || w[2], w[3], w[4] || ' ' || w[5]]) AS p, unnest([0, 1, 2]) AS k, unnest([1.2, NULL, CASE item_id % 2 WHEN 0 THEN 0.8 END]) AS own, CASE item_id % 3 WHEN 0 THEN 0.7 END AS row_weight FROM w WHERE item_id % 5 > 0),
 rules AS (SELECT scope, slug, '(' || p || ')' AS p, coalesce(own, row_weight, 1.0) AS weight, k FROM t),
 d AS (SELECT doc_id AS id, source AS scope, {sql_pick('doc_id', _TITLES)} || CASE WHEN doc_id % 4 = 0 THEN repeat(' .', 300) ELSE chr(10) END AS title, text, {sql_pick('doc_id', _FILE_TYPES)} AS mark FROM documents),
 e AS (SELECT id, scope, mark, (CASE WHEN id % 4 = 0 THEN repeat('. ', 300) ELSE '' END || title || coalesce(text, ''))[1:4000] AS head FROM d),
 f AS (SELECT id, head, slug, p, weight, row_number() OVER (PARTITION BY id ORDER BY r.scope IS NULL, slug, k) AS pos FROM e JOIN rules r ON r.scope = e.scope OR r.scope IS NULL),
 own AS (SELECT * FROM f WHERE regexp_matches(head, '(?i)' || p)),
 built AS (SELECT id, head, slug, p, weight, pos FROM e CROSS JOIN (VALUES {_BUILTIN}) b(slug, p, weight, pos) WHERE id NOT IN (SELECT id FROM own) AND regexp_matches(head, '(?i)' || p)),
 u AS (SELECT *, regexp_extract(head, '(?i)' || p, 1) AS m, length(regexp_extract(head, '(?is)^(.*?)' || replace(p, '(?:^|', '(?:'), 1)) < 500 AS titled FROM (SELECT *, 'own' AS rules FROM own UNION ALL SELECT *, 'builtin' FROM built) x),
 h AS (SELECT id, slug, pos, rules, m, titled, weight * CASE WHEN titled THEN 1.5 ELSE 1.0 END AS weight FROM u),
 s AS (SELECT id, slug, rules, max((weight, length(m))) AS best, min(pos) AS pos, arg_max(m, (weight, length(m), -pos)) AS m, arg_max(titled, (weight, length(m), -pos)) AS titled FROM h GROUP BY ALL),
 o AS (SELECT id, count(*) AS candidates, any_value(rules) AS rules FROM h GROUP BY 1),
 b AS (SELECT id, slug, best[1] AS weight, m, titled FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY best[1] DESC, best[2] DESC, pos) = 1),
 j AS (SELECT e.id, b.slug AS bs, b.weight AS bw, b.m AS bm, mark, k.best[1] AS kw, k.m AS km, coalesce(b.titled, false) AS titled FROM e LEFT JOIN b USING (id) LEFT JOIN s k ON k.id = e.id AND k.slug = mark),
 x AS (SELECT id, CASE WHEN mark IS NULL OR mark = bs THEN bs WHEN bs IS NOT NULL AND titled THEN bs WHEN bs IS NULL OR coalesce(kw + 1, 5.5) >= bw THEN mark ELSE bs END AS slug, bs, bw, bm, mark, km FROM j)
 SELECT x.id, x.slug, round(CASE WHEN x.slug IS NULL THEN 0 WHEN x.slug = bs AND mark = bs THEN least(1, bw + 1) WHEN x.slug = bs THEN least(1, bw) ELSE 1 END, 6)::DOUBLE AS score, CASE WHEN x.slug = bs THEN bm ELSE coalesce(km, 'filename:' || x.slug) END AS matched, coalesce(candidates, 0) AS candidates, rules FROM x LEFT JOIN o USING (id)""")
def scoped_types(spark, sf):
    """Documents by the rules of their source, made of the benchmark's words, and by the built-in rules where none matches."""
    w = table(spark, sf, "benchmark").where("item_id % 5 > 0").withColumn("w", F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))
    word = lambda i: F.get("w", F.lit(i))
    k, null = F.col("item_id"), F.lit(None).cast("double")
    types = w.select(
        F.when(k % 8 > 0, F.concat(F.lit("src"), k % 20)).alias("scope"), F.concat(F.lit("b"), k).alias("slug"),
        F.array(F.concat(word(0), F.lit(r"\s+"), word(1)), word(2), F.concat(word(3), F.lit(" "), word(4)), F.lit("(broken")).alias("keywords"),
        F.array(F.lit(1.2), null, F.when(k % 2 == 0, 0.8)).alias("weights"), F.when(k % 3 == 0, 0.7).alias("weight"), F.lit(True).alias("active"),
    )
    i = F.col("doc_id")
    far = i % 4 == 0
    text = F.concat(F.when(far, ". " * 300).otherwise(""), pick(i, _TITLES), F.when(far, " ." * 300).otherwise("\n"), F.coalesce("text", F.lit("")))
    own = table(spark, sf, "documents")
    docs = own.select(i.alias("id"), F.col("source").alias("scope"), F.substring(text, 1, classify.HEAD).alias("text"), pick(i, _FILES).alias("name"))
    return _round(classify.classify_scoped(spread(docs, "id", rows_of=own), types).drop("ranked"), "score")


_MIMES, _NAMES = ("application/pdf", "image/png", "application/xml", "text/plain"), ("Invoice_%s.pdf", "scan_%s.png", "data.xml", "100%_%s.txt")


@query(f"""{JOBS}, j AS (SELECT *, owner % 3 AS tenant, owner % 5 AS project, {sql_pick('id', ('pdf', 'image', 'xml', 'other'))} AS format, replace({sql_pick('id', _NAMES)}, '%s', id::VARCHAR) AS file FROM jobs)
 SELECT id, file AS file_name FROM j WHERE status = 'done' AND doc_type IN ('1', '2', '4') AND format IN ('pdf', 'other') AND tenant = 1 AND project IN (1, 2, 4) AND created_at >= (SELECT min(created_at) FROM jobs) AND (file ILIKE '%\\_%' ESCAPE '\\') ORDER BY created_at DESC, id LIMIT 40 OFFSET 5""")
def job_filters(spark, sf):
    i = F.col("id")
    j = jobs(spark, sf).withColumns({"tenant": F.col("owner") % 3, "project": F.col("owner") % 5, "mime": pick(i, _MIMES), "file_name": F.replace(pick(i, _NAMES), F.lit("%s"), i.cast("string"))})
    found = lifecycle.visible(j, projects=[1, 2, 4]).where(lifecycle.wanted("done", ["1", "2", "4"], ["pdf", "other"], tenant=1, since="2000-01-01", text=" _ "))
    return lifecycle.page(found, [F.desc("created_at"), F.col("id")], 40, 5).select("id", "file_name")


_ACTIONS = ("approve", "flag", "correct", "draft", "flag", "approve", "nod")


@query(f"""WITH RECURSIVE {JOBS[5:]}, j AS (SELECT id, status, CAST(owner AS VARCHAR) AS extracted, CASE WHEN id % 3 = 0 THEN ['old'] END AS issues, CASE WHEN id % 4 = 0 THEN 1 END AS corrected_at FROM jobs),
 a AS (SELECT l_orderkey AS id, {sql_pick('l_partkey', _ACTIONS)} AS action, 'r' || l_suppkey AS new, 'why ' || l_linenumber AS reason, 10 + l_linenumber // 2 AS tm, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber // 2, l_linenumber, action, new, reason) AS n FROM lineitem),
 f AS (SELECT *, 0::BIGINT AS n FROM j UNION ALL SELECT f.id,
  CASE WHEN action = 'approve' AND status = 'needs_review' THEN 'done' WHEN action = 'correct' THEN 'done' WHEN action = 'flag' AND status IN ('done', 'needs_review') THEN 'needs_review' ELSE status END,
  CASE WHEN action IN ('correct', 'draft') THEN new ELSE extracted END, CASE WHEN action IN ('correct', 'draft') THEN NULL WHEN action = 'flag' AND status IN ('done', 'needs_review') THEN list_append(coalesce(issues, []), reason) ELSE issues END,
  CASE WHEN action IN ('correct', 'draft') THEN tm WHEN action = 'approve' AND status = 'needs_review' THEN coalesce(corrected_at, tm) ELSE corrected_at END, a.n FROM f JOIN a ON a.id = f.id AND a.n = f.n + 1)
 SELECT id, status, extracted, array_to_string(issues, ';') AS issues, coalesce(corrected_at, 0) AS corrected_at FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1""")
def reviewed_jobs(spark, sf):
    """Jobs after review actions made of order lines: approvals, corrections, drafts and flags in time order."""
    i = F.col("id")
    j = jobs(spark, sf).select("id", "status", F.col("owner").cast("string").alias("extracted"), F.when(i % 3 == 0, F.array(F.lit("old"))).alias("issues"), F.when(i % 4 == 0, 1).cast("long").alias("corrected_at"))
    line = F.col("l_linenumber")
    actions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.expr("10 + l_linenumber div 2").cast("long").alias("at"), line.alias("seq"), pick(F.col("l_partkey"), _ACTIONS).alias("action"), F.concat(F.lit("r"), "l_suppkey").alias("extracted"), F.concat(F.lit("why "), line).alias("reason"))
    return lifecycle.review(j, actions).withColumns({"issues": F.array_join("issues", ";"), "corrected_at": F.coalesce("corrected_at", F.lit(0))})


@query(f"""{JOBS}, n AS (SELECT max(created_at) AS now FROM jobs) SELECT id, status FROM jobs, n WHERE status IN ('done', 'needs_review') AND id % 5 > 0 AND id % 7 > 0 AND id % 3 > 0 AND owner % 30 < 20 AND created_at < now - INTERVAL 5 MINUTES ORDER BY created_at, id LIMIT 50""")
def due_deliveries(spark, sf):
    i = F.col("id")
    j = jobs(spark, sf).withColumns({"url": F.when(i % 5 > 0, "https://x"), "delivered_at": F.when(i % 7 == 0, F.col("created_at")), "last_error": F.when(i % 3 > 0, "503"), "attempts": F.col("owner") % 30, "updated_at": F.col("created_at")})
    now = F.broadcast(j.agg(F.max("created_at").alias("now")))  # one row
    return lifecycle.due_deliveries(j.crossJoin(now), F.col("now")).select("id", "status")


@query("""WITH i AS (SELECT event_id, ts AS received_at, CASE WHEN event_id % 4 = 0 THEN 0 END AS processed, user_id % 13 AS attempts, 'old' AS last_error FROM events),
 p AS (SELECT event_id FROM i WHERE processed IS NULL AND attempts < 10 ORDER BY received_at, event_id LIMIT 50), r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN repeat('e', 600) END AS error FROM p)
 SELECT event_id, CASE WHEN r.event_id IS NOT NULL AND error IS NULL THEN 1 ELSE coalesce(processed, -1) END AS processed_at, attempts + CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END AS attempts, CASE WHEN error IS NOT NULL THEN error[1:500] WHEN r.event_id IS NULL THEN last_error END AS last_error FROM i LEFT JOIN r USING (event_id)""")
def settled_inbox(spark, sf):
    """The inbox after one drain: some of the waiting events are processed, some fail once more."""
    i = table(spark, sf, "events").select("event_id", F.col("ts").alias("received_at"), F.when(F.col("event_id") % 4 == 0, 0).alias("processed_at"), (F.col("user_id") % 13).alias("attempts"), F.lit("old").alias("last_error"))
    results = lifecycle.pending_events(i).select("event_id", F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("e"), F.lit(600))).alias("error"))
    return lifecycle.settle(i, results, F.lit(1)).drop("received_at").withColumn("processed_at", F.coalesce("processed_at", F.lit(-1)))


@query("""SELECT event_id, props ->> '$.k' AS k, CASE WHEN event_id % 3 > 0 THEN CAST(user_id AS VARCHAR) END AS reclaims, event_id % 2 = 0 AS has_note, CASE event_id % 2 WHEN 0 THEN 'a"b' END AS note FROM events""")
def merged_metadata(spark, sf):
    """Metadata with members of a patch: a count (null for some) and a note, beside what was there."""
    i = F.col("event_id")
    patch = F.concat(F.lit('{"reclaims": '), F.when(i % 3 > 0, F.col("user_id").cast("string")).otherwise("null"), F.when(i % 2 == 0, ', "note": "a\\"b"').otherwise(""), F.lit("}"))
    m = table(spark, sf, "events").select(i, lifecycle.merge_object(F.col("props"), patch).alias("m"))
    at = lambda p: F.get_json_object("m", f"$.{p}")
    return m.select("event_id", at("k").alias("k"), at("reclaims").alias("reclaims"), at("note").isNotNull().alias("has_note"), at("note").alias("note"))


_Q = """list_sum([CASE WHEN {0} = 0 THEN 1.5 ELSE 0 END, CASE WHEN {0} > 0 AND conf >= 0.8 AND {1} > 4.2 THEN 0.6 ELSE 0 END, CASE WHEN {2} THEN 1 ELSE 0 END, CASE WHEN {3} THEN 1 ELSE 0 END])"""
_F = """list_filter([CASE WHEN {0} = 0 THEN 'empty_extract' END, CASE WHEN {0} > 0 AND conf >= 0.8 AND {1} > 4.2 THEN 'confident_sparse' END, CASE WHEN {2} THEN 'truncated_json' END, CASE WHEN {3} THEN 'reasoning_bleed' END], lambda x: x IS NOT NULL)"""
_FIRST, _SECOND = ("id % 3", "id % 7", "id % 5 = 0", "id % 2 = 0"), ("(id + 1) % 4", "(id + 3) % 7", "id % 9 = 0", "id % 13 = 0")


@query(f"""WITH e AS (SELECT event_id AS id, value / 1000 AS conf, user_id FROM events), t AS (SELECT *, {_Q.format(*_FIRST)} AS s1, {_F.format(*_FIRST)} AS f1, {_Q.format(*_SECOND)} AS s2, {_F.format(*_SECOND)} AS f2 FROM e),
 p AS (SELECT *, s1 >= 1 AS again, CASE WHEN id % 4 > 0 AND id % 6 > 0 AND user_id % 2 = 0 AND (list_contains(f1, 'truncated_json') OR (list_contains(f1, 'empty_extract') AND user_id % 3 > 0)) THEN 'multipass' WHEN s1 >= 1 AND id % 10 > 0 AND id % 10 <> 5 THEN 'retry' ELSE 'keep' END AS plan FROM t),
 c AS (SELECT *, plan <> 'keep' AND id % 11 > 0 AND (s2 < s1 OR (s2 = s1 AND (id + 3) % 7 < id % 7)) AS won FROM p)
 SELECT id, plan, CASE WHEN won THEN 'second' ELSE 'first' END AS chosen, CASE WHEN won THEN 'b' ELSE 'a' END AS extracted, round(CASE WHEN won THEN s2 ELSE s1 END, 6)::DOUBLE AS score, CASE WHEN plan <> 'keep' OR again THEN array_to_string(CASE WHEN won THEN f2 ELSE f1 END, ',') ELSE '' END AS factors FROM c""")
def second_extractions(spark, sf):
    """Which doubtful extractions are made again, how, and which of both results stays."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("value") / 1000).alias("conf"), "user_id")
    i, u = F.col("id"), F.col("user_id")

    def judged(fields, missing, cut, bleed):
        response = F.concat(F.when(bleed, BLEED).otherwise(""), F.when(cut, '{"a": {').otherwise('{"a": 1}'))
        return rc.quality(fields, F.lit(6), missing, F.col("conf"), response, F.lit("plain words only " * 5))

    first = e.select("id", "user_id", judged(i % 3, i % 7, i % 5 == 0, i % 2 == 0).alias("quality"), (i % 7).alias("n_missing"), F.lit("a").alias("extracted"))
    plan = lifecycle.second_plan(F.col("quality"), i % 4 == 0, i % 6 > 0, u % 2 == 0, u % 3, F.when(i % 10 > 0, "other"), F.when(i % 10 == 5, "other").otherwise("usual"))
    second = e.where("id % 11 > 0").select("id", judged((i + 1) % 4, (i + 3) % 7, i % 9 == 0, i % 13 == 0).alias("quality"), ((i + 3) % 7).alias("n_missing"), F.lit("b").alias("extracted"))
    out = lifecycle.choose_extraction(first.withColumn("plan", plan), second)
    return out.select("id", "plan", "chosen", "extracted", F.round("quality.score", 6).alias("score"), F.array_join("factors", ",").alias("factors"))


_NOTES = ("multipass_chunk_failed: 2", "xlsx_fast_path", "multipass_chunks_truncated", "other")


@query(f"""WITH r AS (SELECT doc_id AS id, lang, source, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0 AND length(x) - length(regexp_replace(x, '[,\\t;|]', '', 'g')) >= 2)) AS n FROM documents),
 t AS (SELECT *, list_filter([CASE WHEN id % 9 = 0 THEN 'total' END, CASE WHEN id % 8 = 0 THEN 'truncated_json' END, CASE WHEN id % 4 IN (0, 2) AND id % 3 = 0 THEN {sql_pick('id', _NOTES)} END, CASE WHEN id % 7 = 0 AND id % 5 > 0 AND id % 2 = 0 THEN 'extract_empty' END, CASE WHEN id % 6 > 0 AND (lang IS NULL OR id % 10 < 3) THEN 'classify_uncertain' END, CASE WHEN n > 400 THEN 'complex_document_deferred' END], lambda x: x IS NOT NULL) AS issues FROM r)
 SELECT id, CASE WHEN len(issues) > 0 OR id % 17 = 0 THEN 'needs_review' ELSE 'done' END AS status, array_to_string(issues, ';') AS issues, n > 400 AS deferred FROM t""")
def job_outcomes(spark, sf):
    """Status and issues of a job for each document, with the rows that its text really has."""
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    some = lambda on, word: F.when(on, F.array(F.lit(word)))
    notes = F.when(i % 3 == 0, F.array(pick(i, _NOTES)))
    out = lifecycle.outcome(some(i % 9 == 0, "total"), some(i % 8 == 0, "truncated_json"), notes, i % 7, i % 5 == 0, i % 2 > 0, F.col("lang"), (i % 10) / 6, i % 6 == 0, i % 17 == 0, tx.table_row_count(F.col("text")))
    return d.select(i.alias("id"), out.alias("o")).select("id", "o.status", F.array_join("o.issues", ";").alias("issues"), "o.deferred")


_MEASURES = """count(*) AS total, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'needs_review') AS n_needs_review, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'pending') AS n_pending,
 count(*) FILTER (status = 'processing') AS n_processing, count(*) FILTER (id % 3 = 0) AS with_issues, count(*) FILTER (id % 4 > 0) AS with_model, round(avg(confidence) FILTER (status IN ('done', 'needs_review')), 6) AS avg_confidence,
 round(quantile_cont(latency, 0.5) FILTER (status <> 'pending'), 6) AS p50, round(quantile_cont(latency, 0.95) FILTER (status <> 'pending'), 6) AS p95, round(quantile_cont((owner * 7)::DOUBLE, 0.95) FILTER (id % 4 > 0), 6) AS tokens_in_p95,
 round(quantile_cont((id % 90)::DOUBLE, 0.95) FILTER (id % 4 > 1), 6) AS tokens_out_p95, round(quantile_cont(latency * 2, 0.95) FILTER (id % 4 > 0), 6) AS model_ms_p95"""
_RATES = "round(n_done / total, 6) AS done_rate, round(n_needs_review / total, 6) AS review_rate, round(n_failed / total, 6) AS failed_rate, round(with_issues / total, 6) AS issue_rate, round(with_model / total, 6) AS model_rate"


def _called_jobs(spark, sf):
    i = F.col("id")
    return jobs(spark, sf).withColumns({
        "issues": F.when(i % 3 == 0, F.array(F.lit("x"))).when(i % 3 == 1, F.array().cast("array<string>")), "used_model": i % 4 > 0, "latency": F.when(F.col("status") != "pending", F.col("latency")),
        "tokens_in": F.when(i % 4 > 0, (F.col("owner") * 7).cast("double")), "tokens_out": F.when(i % 4 > 1, (i % 90).cast("double")), "model_ms": F.when(i % 4 > 0, F.col("latency") * 2),
    })


_ROUNDED = ("avg_confidence", "p50", "p95", "tokens_in_p95", "tokens_out_p95", "model_ms_p95", "done_rate", "review_rate", "failed_rate", "issue_rate", "model_rate")


@query(f"{JOBS}, m AS (SELECT {_MEASURES} FROM jobs) SELECT *, {_RATES}, round(floor(total / 168.0 * 100 + 0.5) / 100, 6)::DOUBLE AS per_hour FROM m")
def operational_summary(spark, sf):
    """Jobs with issues, model calls, tokens and times beside the counts by status."""
    return _round(metrics.operational(_called_jobs(spark, sf), hours=168.0), *_ROUNDED, "per_hour")


@query(f"{JOBS}, m AS (SELECT coalesce(doc_type, '_unknown') AS key, {_MEASURES} FROM jobs GROUP BY 1) SELECT *, {_RATES} FROM m")
def operational_by_type(spark, sf):
    return _round(metrics.operational(_called_jobs(spark, sf).withColumn("key", F.coalesce("doc_type", F.lit("_unknown"))), ["key"]), *_ROUNDED)


@query("""WITH l AS (SELECT l_orderkey AS id, l_quantity AS q, l_suppkey AS s, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem),
 m AS (SELECT id, 'items.' || i || '.qty' AS path, CAST(q::BIGINT AS VARCHAR) AS a, CAST(q::BIGINT + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS b FROM l
  UNION ALL SELECT id, 'items.' || i || '.by.no', s::VARCHAR, s::VARCHAR FROM l WHERE n % 3 > 0 UNION ALL SELECT id, 'items.' || i || '.by.no', s::VARCHAR, NULL FROM l WHERE n % 3 = 0
  UNION ALL SELECT id, 'items.' || i || '.marks.0', NULL, n::VARCHAR FROM l WHERE n % 4 = 0
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'F' ELSE o_orderstatus END FROM orders WHERE o_orderkey IN (SELECT id FROM l))
 SELECT id, path, a AS before, b AS after FROM m WHERE a IS DISTINCT FROM b""")
def diff_records(spark, sf):
    """Leaves that differ between two nested records of an order: changed counts, lost suppliers, new marks."""
    n = F.col("l_linenumber")
    line = lambda qty, no, marks: F.struct(qty.cast("long").alias("qty"), F.struct(no.alias("no")).alias("by"), marks.alias("marks"), F.lit("x").alias("_issues"))
    old = line(F.col("l_quantity"), F.col("l_suppkey"), F.array().cast("array<long>"))
    new = line(F.col("l_quantity") + F.when(n % 2 == 0, 1).otherwise(0), F.when(n % 3 > 0, F.col("l_suppkey")), F.when(n % 4 == 0, F.array(n)))
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", old.alias("old"), new.alias("new"))))
    o = spread(table(spark, sf, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(order.alias("l")).join(table(spark, sf, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    record = lambda side, status: F.to_json(F.struct(status.alias("status"), F.transform("l", lambda x: x[side]).alias("items"), F.array(F.lit(side)).alias("_field_confidence")))
    status = F.col("o_orderstatus")
    return tables.diff_records(o.select(F.col("l_orderkey").alias("id"), record("old", status).alias("old"), record("new", F.when(status == "O", "F").otherwise(status)).alias("new")))


@query(f"""{ITEMS}, g AS (SELECT doc, rate, count(*) AS n FROM items WHERE doc % 3 > 0 GROUP BY 1, 2), r AS (SELECT doc, arg_max(rate, (n, rate)) AS modal FROM g GROUP BY 1),
 h AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS total, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS with_vat, CASE WHEN o_orderkey % 5 < 2 THEN floor(o_totalprice / 1.2 * 100 + 0.5) / 100 END AS net, CASE WHEN o_orderkey % 5 IN (1, 2) THEN floor(o_totalprice / 11 * 100 + 0.5) / 100 END AS vat, CASE WHEN o_orderkey % 11 = 0 THEN 18.0 END AS rate FROM orders),
 x AS (SELECT *, coalesce(total, with_vat) AS gross, vat / nullif(coalesce(net, coalesce(total, with_vat) - vat), 0) * 100 AS implied FROM h),
 y AS (SELECT *, floor(gross * 100 + 0.5) / 100 AS t2, floor((gross - vat) * 100 + 0.5) / 100 AS n2, floor((gross - net) * 100 + 0.5) / 100 AS v2, coalesce((SELECT c FROM (VALUES (0.0), (5.0), (7.0), (10.0), (18.0), (20.0), (22.0)) s(c) WHERE abs(implied - c) <= 0.6), floor(implied * 100 + 0.5) / 100) AS snapped FROM x),
 z AS (SELECT y.*, CASE WHEN rate IS NULL AND gross IS NOT NULL THEN coalesce(modal, snapped) END AS r2 FROM y LEFT JOIN r USING (doc))
 SELECT doc, round(coalesce(total, t2), 2) AS total, round(coalesce(net, n2), 2) AS net, round(coalesce(vat, v2), 2) AS vat, round(coalesce(rate, r2), 2)::DOUBLE AS rate, concat_ws(',', CASE WHEN total IS NULL AND t2 IS NOT NULL THEN 'total' END, CASE WHEN net IS NULL AND n2 IS NOT NULL THEN 'net' END, CASE WHEN vat IS NULL AND v2 IS NOT NULL THEN 'vat' END, CASE WHEN r2 IS NOT NULL THEN 'rate' END) AS derived FROM z""")
def derived_headers(spark, sf):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    h = table(spark, sf, "orders").select(k.alias("doc"), F.when(k % 2 == 0, price).alias("total"), F.when(k % 7 > 0, price).alias("total_with_vat"), F.when(k % 5 < 2, cents(price / 1.2)).alias("net"), F.when((k % 5).isin(1, 2), cents(price / 11)).alias("vat"), F.when(k % 11 == 0, 18.0).alias("rate"))
    out = totals.derive_header(h, items(spark, sf).where("doc % 3 > 0"))
    return out.withColumns({c: F.round(c, 2) for c in ("total", "net", "vat", "rate")}).withColumn("derived", F.array_join("derived", ","))


@query("""WITH w AS (SELECT DISTINCT 'c' || (n_regionkey) AS category, n_regionkey AS priority, unnest([CASE n_regionkey WHEN 0 THEN 'ring' WHEN 1 THEN 'widget' WHEN 2 THEN 'eco' ELSE 'r' || n_regionkey END, CASE n_regionkey WHEN 0 THEN 'red' WHEN 3 THEN 'small' ELSE 'standard' END]) AS word FROM nation),
 t AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS t, CASE p_partkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'other' WHEN 2 THEN '' END AS preset FROM part),
 h AS (SELECT id, category, priority, count(*) AS n FROM t JOIN w ON contains(t, word) GROUP BY ALL), b AS (SELECT id, category FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, priority) = 1)
 SELECT t.id, CASE WHEN preset = 'own' THEN 'own' ELSE coalesce(category, 'other') END AS category FROM t LEFT JOIN b USING (id)""")
def categories_by_table(spark, sf):
    """Parts by a table of words, one category for each region; items with a category keep it."""
    r = F.col("n_regionkey")
    word = F.array(F.when(r == 0, "ring").when(r == 1, "widget").when(r == 2, "eco").otherwise(F.concat(F.lit("r"), r)), F.when(r == 0, "red").when(r == 3, "small").otherwise("standard"))
    words = table(spark, sf, "nation").select(F.concat(F.lit("c"), r).alias("category"), r.alias("priority"), F.explode(word).alias("word"))
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.when(k % 4 == 0, "own").when(k % 4 == 1, "other").when(k % 4 == 2, "").alias("preset"))
    return tables.categorize_by(p, words).select("id", "category")


@query("""WITH f AS (SELECT lang, field, count(e) AS n, count(*) FILTER (e = a) AS m FROM (SELECT lang, 'quality' AS field, quality AS e, CASE WHEN doc_id % 5 > 0 THEN quality END AS a FROM labels JOIN documents USING (doc_id) UNION ALL SELECT lang, 'toxic', toxic, quality FROM labels JOIN documents USING (doc_id)) t GROUP BY 1, 2),
 r AS (SELECT lang, field, n AS n_expected, m AS n_matched, round(CASE WHEN n = 0 THEN 1 ELSE m / n END, 6)::DOUBLE AS recall, CASE WHEN field = 'quality' THEN CASE lang WHEN 'en' THEN 0.95 ELSE 0.7 END WHEN lang = 'en' THEN 0.01 END AS least FROM f) SELECT *, least IS NULL OR recall >= least AS passed FROM r""")
def recall_gates(spark, sf):
    """Recall of two fields for each language against the least that is asked for."""
    t = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    pair = lambda name, e, a: F.struct(F.lit(name).alias("field"), e.alias("expected"), a.alias("actual"))
    q = F.col("quality")
    t = t.select("lang", F.explode(F.array(pair("quality", q, F.when(F.col("doc_id") % 5 > 0, q)), pair("toxic", F.col("toxic"), q))).alias("p")).select("lang", "p.*")
    found = _round(tables.recall(t, "lang", "field"), "recall")
    limits = spark.createDataFrame([("en", "quality", 0.95), (None, "quality", 0.7), ("en", "toxic", 0.01)], "lang string, field string, least double")
    return tables.recall_gate(found, limits, "lang")


@query("""WITH v AS (SELECT c_custkey AS id, unnest([CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR END, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey ELSE 'gone' END, NULL]) AS value, unnest([0, 1, 2]) AS place FROM customer),
 e AS (SELECT s_suppkey AS entry_id, unnest([s_suppkey::VARCHAR, 'n' || s_nationkey]) AS value FROM supplier WHERE s_nationkey < 15),
 h AS (SELECT DISTINCT id, place, entry_id FROM v JOIN e USING (value)), f AS (SELECT id, entry_id FROM h QUALIFY place = min(place) OVER (PARTITION BY id))
 SELECT c_custkey AS id, coalesce(entry_id, -1) AS entry_id, CASE WHEN entry_id IS NULL THEN 'not_found' ELSE 'exact' END AS method FROM customer LEFT JOIN f ON id = c_custkey""")
def entity_links(spark, sf):
    """Customers linked to suppliers by code, else by nation, with codes that no supplier has, several hits and no hit at all."""
    k = F.col("c_custkey")
    values = F.array(F.when(k % 3 == 0, k.cast("string")), F.when(k % 2 == 0, F.concat(F.lit("n"), "c_nationkey")).otherwise("gone"), F.lit(None).cast("string"))
    v = table(spark, sf, "customer").select(k.alias("id"), F.posexplode(values).alias("place", "value")).withColumn("field", F.lit("any"))
    entries = table(spark, sf, "supplier").where("s_nationkey < 15").select(F.col("s_suppkey").alias("entry_id"), F.array(F.col("s_suppkey").cast("string"), F.concat(F.lit("n"), "s_nationkey")).alias("keys"))
    return resolve.exact_links(v, entries).withColumn("entry_id", F.coalesce("entry_id", F.lit(-1)))
