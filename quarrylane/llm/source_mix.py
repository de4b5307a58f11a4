"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, small_side, staged


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(table: DataFrame, group: Sequence[str], weight: str, size: str, cap: int, total: str, scale: str) -> DataFrame:
    """Adds ``level`` and ``level_capped``: the amount a row gets is ``level * weight * scale`` unless that exceeds
    ``cap * size``, when it gets the cap and the excess goes to the other rows of its group by weight.

    Rows reach their cap in the order of cap / (weight * scale); with the k first at their cap the level is
    (total - their caps) / (weights of the rest), and the smallest k that no further row exceeds is the answer."""
    per = (F.col(size) * cap).cast("double") / (F.col(weight) * F.col(scale)).cast("double")
    t = table.withColumn("_ratio", F.when(F.col(scale) > 0, per).otherwise(F.lit(0.0)))
    up = Window.partitionBy(*group).orderBy("_ratio", weight, size, "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    w, c = F.col(weight) * F.col(scale), F.col(size) * cap
    t = t.withColumn("_before_w", F.sum(w).over(up) - w).withColumn("_before_c", F.sum(c).over(up) - c)
    t = t.withColumn("_all_w", F.sum(w).over(whole))
    rest = F.col("_all_w") - F.col("_before_w")
    t = t.withColumn("_level", F.when(rest > 0, (F.col(total) - F.col("_before_c")).cast("double") / rest.cast("double")))
    t = t.withColumn("level", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(whole)["_level"])
    t = t.withColumn("level_capped", F.col("level").isNull() | (F.col("_ratio") < F.col("level")))
    return t.drop("_ratio", "_before_w", "_before_c", "_all_w", "_level")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """Copies of each document that a mix with given source weights takes.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share all words; a source stops at
    ``max_repeats`` times its words and the excess is shared again by weight. Within a source a document's inclusion
    weight falls slowly with its length class (64 less the bits of its word count), so expected copies are unequal:
    the whole part is allocated for certain, the fraction is the inclusion probability p of a Pareto order sample.
    Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a hash of doc_id and seed, and taken in that order
    while the source's remaining words last; then, twice, the largest that still fits, and at last the one whose size is
    nearest to the words still missing if it brings the source nearer. Ranks are cumulated over hash-free buckets of the score whose number is the root
    of the source's documents, so no source passes through one task.

    Returns doc_id, source, size, source_size, target, copies, taken (= copies * size). Null and empty texts have size 0 and get no copy; a source
    of such texts alone has target 0. Repeated rows are ranked apart only if their doc_id differs; those with the same
    doc_id are taken or left together. Columns other than doc_id, source and text aren't read."""
    base = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    cls = F.length(F.bin("size")).cast("long")
    base = base.withColumn("cls", cls).withColumn("w", F.lit(64) - cls)
    strata = staged(base.groupBy("source", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("stratum_size"), F.first("w").alias("w")), "mix-strata")
    sources = strata.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum("stratum_size").alias("source_size"))
    # One row for each source from here to the strata: as many as the corpus has sources, not documents.
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("_rank", k).withColumn("source_w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long"))
    sources = sources.withColumn("_all", F.sum("source_size").over(Window.partitionBy())).withColumn("_one", F.lit(1)).withColumn("_unit", F.lit(1).cast("long")).withColumn("_key", F.col("_rank").cast("long"))
    sources = water_fill(sources, ["_one"], "source_w", "source_size", max_repeats, "_all", "_unit")
    target = F.when(F.col("level_capped"), (F.col("source_size") * max_repeats).cast("double")).otherwise(F.col("level") * F.col("source_w").cast("double"))
    sources = sources.select("source", "n_docs", "source_size", target.alias("target"))
    s = small_side(staged(sources, "mix-sources")).alias("s")
    plan = strata.alias("t").join(s, F.col("s.source").eqNullSafe(F.col("t.source"))).select("t.source", "cls", "w", "stratum_size", "n_docs", "source_size", "target").withColumn("_key", F.col("cls"))
    plan = water_fill(plan, ["source"], "w", "stratum_size", max_repeats, "target", "stratum_size")
    expected = F.when(F.col("stratum_size") == 0, F.lit(0.0)).when(F.col("level_capped"), F.lit(float(max_repeats))).otherwise(F.least(F.lit(float(max_repeats)), F.col("level") * F.col("w").cast("double")))
    plan = plan.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("whole").cast("double"))
    whole_words = F.sum(F.col("whole") * F.col("stratum_size")).over(Window.partitionBy("source"))
    plan = plan.withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - whole_words)
    plan = staged(plan.select("source", "cls", "n_docs", "source_size", "target", "whole", "p", "rest"), "mix-plan")

    b, p = base.alias("b"), small_side(plan).alias("p")
    d = b.join(p, F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.cls") == F.col("p.cls"))).select("b.doc_id", "b.source", "b.size", "p.n_docs", "p.source_size", "p.target", "p.whole", "p.p", "p.rest")
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1.0 - u)) / (F.col("p") / (1.0 - F.col("p")))
    d = d.withColumn("score", F.when((F.col("p") > 0) & (F.col("size") > 0), odds))
    cells = F.ceil(F.sqrt("n_docs"))
    d = d.withColumn("cell", F.least(cells - 1, F.floor(F.col("score") / (1.0 + F.col("score")) * cells)).cast("long"))
    d = staged(d.drop("n_docs"), "mix-scores")
    ranked = d.where("score IS NOT NULL")
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = ranked.groupBy("source", "cell").agg(F.sum("size").alias("cell_words"), F.first("rest").alias("rest"))
    cell = cell.withColumn("ahead", F.sum("cell_words").over(before) - F.col("cell_words"))
    # Whole cells below the line are taken; only the cell that the line crosses is ranked row by row.
    cross = cell.where((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("cell_words") > F.col("rest")))
    cross = small_side(staged(cross.select(F.col("source").alias("x_source"), F.col("cell").alias("x_cell"), "ahead"), "mix-cross"))
    inner = ranked.join(cross, F.col("source").eqNullSafe(F.col("x_source")) & (F.col("cell") == F.col("x_cell")))
    order = Window.partitionBy("source").orderBy(F.struct("score", "doc_id")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("upto", F.col("ahead") + F.sum("size").over(order))
    cut = inner.where("upto <= rest").groupBy("source").agg(F.max(F.struct("score", "doc_id")).alias("last"), F.max("upto").alias("done"))
    line = cell.groupBy("source").agg(F.max(F.when(F.col("ahead") + F.col("cell_words") <= F.col("rest"), F.col("cell"))).alias("full_to"), F.max(F.when(F.col("ahead") + F.col("cell_words") <= F.col("rest"), F.col("ahead") + F.col("cell_words"))).alias("full_words"))
    cut = cut.select(F.col("source").alias("c_source"), "last", "done")
    line = line.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select("source", F.coalesce("full_to", F.lit(-1)).alias("full_to"), "last", F.coalesce("done", "full_words", F.lit(0)).alias("done"))
    line = small_side(staged(line.select(F.col("source").alias("l_source"), "full_to", "last", "done"), "mix-line"))
    taken = d.join(line, F.col("source").eqNullSafe(F.col("l_source")), "left").drop("l_source")
    chosen = F.col("score").isNotNull() & ((F.col("cell") <= F.col("full_to")) | F.coalesce(F.struct("score", "doc_id") <= F.col("last"), F.lit(False)))
    taken = taken.withColumn("chosen", chosen)
    for last_turn in (False, False, True):
        gap = F.col("rest") - F.col("done")
        fits = ~F.col("chosen") & F.col("score").isNotNull() & (F.col("size") < 2 * gap if last_turn else F.col("size") <= gap)
        near = taken.where(fits).groupBy("source").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("off"), "score", "doc_id", "size")).alias("best"))
        near = small_side(staged(near.select(F.col("source").alias("n_source"), "best"), "mix-fill"))
        taken = taken.join(near, F.col("source").eqNullSafe(F.col("n_source")), "left")
        extra = F.coalesce((F.col("score") == F.col("best.score")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")), F.lit(False))
        taken = taken.withColumn("extra", extra)
        if not last_turn:  # rows that repeat a doc_id are taken together
            words = taken.where("extra").groupBy("source").agg(F.sum("size").alias("words")).select(F.col("source").alias("w_source"), "words")
            taken = taken.join(small_side(staged(words, "mix-filled")), F.col("source").eqNullSafe(F.col("w_source")), "left")
            taken = taken.withColumn("done", F.col("done") + F.coalesce("words", F.lit(0))).drop("w_source", "words")
        taken = taken.withColumn("chosen", F.col("chosen") | F.col("extra")).drop("n_source", "best", "extra")
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + F.col("chosen").cast("long")).cast("long")
    return taken.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    own, times, nth = fresh("id", docs), fresh("copies", docs), fresh("copy", docs)
    copies = mix_sources(docs.select("doc_id", "source", "text"), **options).where("copies > 0").groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(times))
    out = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(own)))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
