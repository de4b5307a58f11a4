"""Sheets, column mapping, merged items, file types and searches. Inputs are made from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as rc
from ..operators import queue, resolve, workbooks
from ..sources import sniff
from ..sources.views import part_list, table
from .extract_queries import pick, sql_pick
from .queries import query


def _sheets(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    cells = F.array(F.when(k % 7 > 0, F.concat(F.lit("name "), k % 5)), F.when(k % 11 > 0, F.lit("a long cell that many rows repeat")).otherwise(" "), k.cast("string"), F.when(k % 7 > 0, k % 3).cast("string"))
    return e.select((F.col("user_id") % 30).alias("sheet"), k.alias("idx"), F.when(k % 13 == 0, F.array(k.cast("string"), F.lit(""))).otherwise(cells).alias("cells"))


@query("""WITH r AS (SELECT user_id % 30 AS sheet, event_id AS idx FROM events), s AS (SELECT DISTINCT sheet FROM r ORDER BY 1 LIMIT 20) SELECT sheet, idx, 2 AS width FROM r WHERE sheet IN (SELECT sheet FROM s) QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY idx) <= 300""")
def sheet_preview(spark, sf):
    return workbooks.preview(_sheets(spark, sf), columns=2).select("sheet", "idx", F.size("cells").alias("width"))


@query("""WITH r AS (SELECT user_id % 30 AS sheet, event_id AS idx, event_id % 13 = 0 OR (event_id % 7 = 0 AND event_id % 11 = 0) AS sep FROM events), p AS (SELECT *, sum(sep::INT) OVER (PARTITION BY sheet ORDER BY idx) AS part FROM r), g AS (SELECT sheet, part, min(idx) AS start, count(*) AS run_rows FROM p WHERE NOT sep GROUP BY 1, 2)
 SELECT sheet, start, run_rows FROM g QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY run_rows DESC, start) = 1""")
def longest_filled_run(spark, sf):
    return workbooks.longest_filled_run(_sheets(spark, sf))


@query("""SELECT user_id % 30 AS sheet, event_id AS idx, CASE WHEN event_id % 13 = 0 THEN event_id || '|' ELSE concat_ws('|', CASE WHEN event_id % 7 > 0 THEN 'name ' || event_id % 5 END, CASE WHEN event_id % 11 > 0 THEN '@1' ELSE ' ' END, event_id::VARCHAR, CASE WHEN event_id % 7 > 0 THEN (event_id % 3)::VARCHAR END) END AS cells FROM events""")
def cell_references(spark, sf):
    rows, _ = workbooks.with_references(_sheets(spark, sf))
    return rows.select("sheet", "idx", F.array_join("cells", "|").alias("cells"))


@query("""WITH r AS (SELECT user_id AS doc, event_id, user_id % 5 AS kind FROM events), n AS (SELECT doc, kind, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS half FROM r GROUP BY 1, 2)
 SELECT doc, CASE WHEN n < 5 THEN 'few' WHEN kind = 1 AND half < 0.7 * n THEN 'gaps' WHEN kind = 2 AND half < 0.7 * n THEN 'words' WHEN kind = 3 THEN 'uncovered' WHEN kind = 4 THEN 'thin' ELSE 'ok' END AS verdict FROM n""")
def mapping_verdict(spark, sf):
    e, k, kind = table(spark, sf, "events"), F.col("event_id"), F.col("user_id") % 5
    cells = F.array(F.when((kind != 1) | (k % 2 == 0), F.lit("n")).otherwise(" "), F.when((kind == 2) & (k % 2 > 0), "many").otherwise("1 000,5"))
    t = e.select(F.col("user_id").alias("doc"), kind.alias("kind"), workbooks.mapped(cells, {"name": 0, "qty": 1}).alias("item"))
    n = e.groupBy(F.col("user_id").alias("doc")).agg(F.count("*").alias("n"))
    t = t.join(n, "doc").withColumn("rows", F.when(F.col("kind") == 3, F.col("n") * 2).otherwise(F.col("n"))).withColumn("width", F.when(F.col("kind") == 4, 8).otherwise(4))
    return workbooks.mapping_verdict(t, "doc", F.col("rows"), F.col("width"), ["name"], ["qty"], 2)


@query("""WITH i AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS chunk, l_linenumber AS pos, CASE WHEN l_linenumber < 6 THEN (l_partkey % 3)::VARCHAR END AS code FROM lineitem),
 d AS (SELECT * FROM i QUALIFY code IS NULL OR row_number() OVER (PARTITION BY doc, code ORDER BY chunk, pos) = 1) SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY chunk, pos) AS line_no, pos FROM d""")
def merge_chunks(spark, sf):
    n = F.col("l_linenumber")
    code = (F.col("l_partkey") % 3).cast("string")
    item = F.when(n < 6, F.create_map(F.when(n % 2 == 0, "sku").otherwise("артикул"), F.concat(F.lit(" A  "), code, F.lit(" ")), F.lit("pos"), n.cast("string"))).otherwise(F.create_map(F.lit("pos"), n.cast("string")))
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (n % 2).alias("chunk"), n.alias("pos"), item.alias("item"))
    return workbooks.merge_chunks(t).select("doc", "line_no", F.element_at("item", F.lit("pos")).cast("int").alias("pos"))


HEADS = ("25504446312E37", "89504E470D0A1A0A00", "FFD8FFE0", "504B0304", "D0CF11E0A1B11AE1", "524946460000000057415645", "4F67675300", "49443303", "FFFB90", "00000018667479704D344120", "000000186674797069736F6D", "EFBBBF3C3F786D6C20", "20203C726F6F743E", "00010203", "")
KINDS = ("application/pdf", "image/png", "image/jpeg", "application/zip", "application/x-cfb", "audio/wav", "audio/ogg", "audio/mpeg", "audio/mpeg", "audio/x-m4a", "audio/mp4", "text/xml", "text/xml", None, None)


@query(f"SELECT event_id, {sql_pick('event_id', KINDS)} AS kind FROM events")
def media_types(spark, sf):
    return table(spark, sf, "events").select("event_id", sniff.media_type(F.unhex(pick(F.col("event_id"), HEADS))).alias("kind"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'doc@id: ' || p_partkey || chr(10) || 'doc/name: ' || p_name || chr(10) || 'doc/row[0]: 1' || chr(10) || 'doc/row[1]: 2' END AS lines FROM part""")
def xml_lines(spark, sf):
    k = F.col("p_partkey")
    xml = F.concat(F.lit("<doc id='"), k, F.lit("'><name>"), F.col("p_name"), F.lit(" </name><row>1</row><row>2</row>"), F.when(k % 4 == 0, "").otherwise("</doc>"))
    return table(spark, sf, "part").select("p_partkey", sniff.xml_lines(xml).alias("lines"))


@query("""SELECT c_custkey FROM (SELECT *, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' 50%_' ELSE '' END AS name, lpad(c_custkey::VARCHAR, 7, '0') AS inn FROM customer) t WHERE name ILIKE '%50!%!_%' ESCAPE '!' OR starts_with(c_custkey::VARCHAR, '50%_') UNION ALL SELECT c_custkey + 1000000 FROM customer WHERE c_name ILIKE '%0000042%' OR starts_with(c_custkey::VARCHAR, '0000042') OR lpad(c_custkey::VARCHAR, 7, '0') = '0000042'""")
def quick_search_escaped(spark, sf):
    c = table(spark, sf, "customer").withColumn("inn", F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    marked = c.withColumn("c_name", F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " 50%_").otherwise("")))
    one = marked.where(resolve.quick_search("50%_", "c_name", "c_custkey", ["inn"])).select("c_custkey")
    return one.unionByName(c.where(resolve.quick_search("0000042", "c_name", "c_custkey", ["inn"])).select((F.col("c_custkey") + 1_000_000).alias("c_custkey")))


@query("""WITH w AS (SELECT s_suppkey AS id, lower(p_name) AS value FROM supplier JOIN part ON p_partkey = s_suppkey UNION SELECT s_suppkey, (s_suppkey * 2)::VARCHAR FROM supplier), h AS (SELECT DISTINCT id, p_partkey AS entry_id, p_name FROM w JOIN part ON value = lower(p_name) OR value = p_partkey::VARCHAR)
 SELECT id, entry_id FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY p_name, entry_id) <= 10""")
def overlap_search(spark, sf):
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    wanted = s.join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("id"), F.array(F.lower("p_name"), (F.col("s_suppkey") * 2).cast("string")).alias("values"))
    rest = s.join(p, F.col("s_suppkey") == F.col("p_partkey"), "left_anti").select(F.col("s_suppkey").alias("id"), F.array((F.col("s_suppkey") * 2).cast("string")).alias("values"))
    return resolve.overlap_search(wanted.unionByName(rest), part_list(spark, sf))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Riga, Brivibas 1' WHEN 1 THEN 'Acme' ELSE 'Minsk' END AS place FROM customer""")
def strip_party(spark, sf):
    k = F.col("c_custkey")
    place = pick(k, ("ООО «Acme», Riga, Brivibas 1", "Acme", "Minsk", "Minsk, SIA Acme"))
    return table(spark, sf, "customer").select("c_custkey", rc.strip_party(place, F.lit('SIA "Acme"')).alias("place"))


@query("""SELECT p_partkey, p_brand AS category, CASE WHEN p_brand < 'Brand#3' THEN 'c-' || p_brand END AS category_id FROM part""")
def category_ids(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("category"), F.lit(None).cast("string").alias("category_id"))
    known = table(spark, sf, "part").select(F.col("p_brand").alias("category")).distinct().where("category < 'Brand#3'").withColumn("category_id", F.concat(F.lit("c-"), F.col("category")))
    return queue.enrich(p, known, "category", ["category_id"]).select("p_partkey", "category", "category_id")


@query("""SELECT conv_id, concat_ws(',', CASE WHEN NOT bool_or(role = 'user') THEN 'user' END, CASE WHEN NOT bool_or(role = 'judge') THEN 'judge' END) AS missing, concat_ws(',', CASE WHEN bool_or(role = 'assistant') THEN 'assistant' END, CASE WHEN bool_or(role = 'system') THEN 'system' END) AS extra FROM conversations GROUP BY 1""")
def set_difference(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    want = F.array(F.lit("user"), F.lit("judge"))
    return t.select("conv_id", F.array_join(F.array_except(want, "r"), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("r", want)), ",").alias("extra"))


REGIONS_SQL = """WITH l AS (SELECT l_suppkey % 20 AS file, 's' || l_suppkey AS sheet, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx, * FROM lineitem),
 c AS (SELECT file, sheet, idx, CASE WHEN l_partkey % 9 = 0 AND l_returnflag <> 'A' THEN 0 WHEN l_partkey % 9 = 1 AND l_returnflag = 'R' THEN 1 ELSE 2 + (l_discount > 0.05)::INT + (l_tax > 0.04)::INT + (l_linenumber = 1)::INT END AS f FROM l),
 p AS (SELECT *, sum((f <= 1)::INT) OVER (PARTITION BY file, sheet ORDER BY idx) AS part FROM c),
 r AS (SELECT file, sheet, part, min(idx) AS a, max(idx) AS b, max(f) AS w, arg_min(idx, (-f, idx)) AS h, arg_max(f, idx) AS lf FROM p WHERE f > 1 GROUP BY ALL),
 q AS (SELECT *, lag(part) OVER o AS pp, lag(b) OVER o AS pb, lag(lf) OVER o AS pf FROM r WINDOW o AS (PARTITION BY file, sheet ORDER BY part)),
 u AS (SELECT *, coalesce(part - pp <= 2 AND pf > w, false) AS above FROM q),
 g AS (SELECT file, sheet, CASE WHEN above THEN pb ELSE h END AS header_row, CASE WHEN above THEN a ELSE h + 1 END AS data_start, w AS width, b + 1 - CASE WHEN above THEN a ELSE h + 1 END AS data_rows FROM u),
 k AS (SELECT *, CAST(sum(data_rows) OVER (PARTITION BY file) AS BIGINT) AS total_rows, row_number() OVER (PARTITION BY file ORDER BY data_rows DESC, sheet, data_start) - 1 AS index FROM g WHERE width >= 3 AND data_rows >= 4),
 t AS (SELECT * FROM k WHERE index < 12)"""


def _books(spark, sf):
    """Sheets of files: a row of up to five cells for each line of a supplier, some blank or a single title."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    cell = lambda on, c: F.when(on, F.col(c).cast("string"))
    full = F.array(F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_quantity").cast("string"), cell(F.col("l_discount") > 0.05, "l_discount"), cell(F.col("l_tax") > 0.04, "l_tax"), F.when(F.col("l_linenumber") == 1, "first").otherwise(""))
    k, flag = F.col("l_partkey") % 9, F.col("l_returnflag")
    cells = F.when((k == 0) & (flag != "A"), F.array(F.lit(""), F.lit("  "))).when((k == 1) & (flag == "R"), F.array(F.lit("title"))).otherwise(full)
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("file"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("sheet"), (F.row_number().over(w) - 1).alias("idx"), cells.alias("cells"))


@query(REGIONS_SQL + """, n AS (SELECT t.file, t.sheet, t.data_start, count(*) AS samples FROM t JOIN c ON c.file = t.file AND c.sheet = t.sheet AND c.idx BETWEEN data_start AND data_start + 1 AND f > 1 GROUP BY ALL)
 SELECT t.file, t.index, t.sheet, t.header_row, t.data_start, t.data_rows, t.width, t.total_rows, f AS header_cells, samples FROM t JOIN n USING (file, sheet, data_start) JOIN c ON c.file = t.file AND c.sheet = t.sheet AND c.idx = header_row""")
def sheet_regions(spark, sf):
    rows = _books(spark, sf)
    found = workbooks.region_samples(workbooks.workbook_report(workbooks.regions(rows)), rows)
    return found.select("file", "index", "sheet", "header_row", "data_start", "data_rows", "width", "total_rows", workbooks.filled(F.col("header")).alias("header_cells"), F.size("samples").cast("long").alias("samples"))


@query(REGIONS_SQL + """, y AS (SELECT *, CASE file % 4 WHEN 0 THEN index = 0 WHEN 1 THEN index = 1 WHEN 2 THEN true ELSE width = (SELECT max(z.width) FROM t z WHERE z.file = t.file) OR index = 0 END AS picked FROM t),
 v AS (SELECT file, max(data_rows) FILTER (picked) AS taken, max(data_rows) FILTER (NOT picked) AS rest, bool_or(NOT picked AND EXISTS (SELECT 1 FROM y z WHERE z.file = y.file AND z.sheet = y.sheet AND z.width = y.width AND z.picked)) AS split FROM y GROUP BY 1)
 SELECT file, CASE WHEN rest > taken THEN 'skipped_bigger' WHEN split THEN 'split_table' ELSE 'ok' END AS verdict FROM v WHERE taken IS NOT NULL""")
def region_choice(spark, sf):
    from pyspark.sql.window import Window

    report = workbooks.workbook_report(workbooks.regions(_books(spark, sf)))
    k, widest = F.col("file") % 4, F.max("width").over(Window.partitionBy("file"))
    wanted = F.when(k == 0, F.col("index") == 0).when(k == 1, F.col("index") == 1).when(k == 2, F.lit(True)).otherwise((F.col("width") == widest) | (F.col("index") == 0))
    return workbooks.choice_verdict(report, report.withColumn("_w", wanted).where("_w").select("file", "index"))
