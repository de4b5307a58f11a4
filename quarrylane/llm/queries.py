"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, jaccard_join, language_id, line_dedup, neighbours, packing, pivot_search, quality, secret_scan, source_mix, suffix_dedup, token_files, whitening


def _tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = language_id.train(docs.where("NOT held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = neighbours.NeighbourGraph.build(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return graph.search(graph.members.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(_documents(spark, sf_dir))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")  # noqa: E731  a filter's second parameter would be the place
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    base = F.sha2(secret_scan.span_text(F.col("base")).cast("binary"), 256)
    return out.select("doc_id", *counts, base.alias("base_sha256"), secret_scan.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_documents(spark, sf_dir)).drop("lang", "source")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.cut_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.token_path(spark)
    token_files.write_token_files(_documents(spark, sf_dir), path, _tokenizer(), end_id=1)
    return token_files.read_token_files(spark, path)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer(), end_id=2)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = whitening.Whitening.fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = fitted.transform().select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(e)) for e in fitted.explained]).cast("array<double>")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"))


def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return pivot_search.PivotIndex.build(table).search(table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mix, op2_jaccard_join, op3_language_id, op4_neighbours, op5_secret_scan, op6_quality, op7_suffix_dedup, op8_token_files, op9_line_dedup, op10_packing, op11_collocations, op12_whitening, op13_pivot_search)}


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: Components by a recursive union over all links between different documents.
OP2_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
 n AS (SELECT doc_id, len(s) AS n FROM s), t AS (SELECT doc_id, unnest(s) AS t FROM s),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
 r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, b FROM r JOIN links ON reached = a)
 SELECT doc_id, CAST(max(n) AS BIGINT) AS n_shingles, min(reached) AS component_id FROM r JOIN n USING (doc_id) GROUP BY 1"""
OP9_SQL = rf"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
 k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM l),
 o AS (SELECT key, min(doc_id) AS own FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), j AS (SELECT k.*, own IS NOT NULL AND own <> doc_id AS gone FROM k LEFT JOIN o USING (key))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY 1"""

#: Phrases of all lengths counted in full; a part of a candidate occurs as often as it, so it is among them.
OP11_SQL = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p), n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY 1),
 g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS t(k) WHERE len(w) >= k),
 f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
 c AS (SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, n, (1000 * c.f * n) // (x.f * y.f) AS score FROM f c JOIN range(1, 5) AS t(j) ON j < c.k JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ')
  WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.lang = c.lang AND b.k > c.k AND b.f >= c.f AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
 b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM c),
 t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE o = 1)
 SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 2000"""
OP13_SQL = """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op9_line_dedup": OP9_SQL, "op11_collocations": OP11_SQL, "op13_pivot_search": OP13_SQL}
