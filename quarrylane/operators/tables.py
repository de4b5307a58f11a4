"""Rows of sheets and pages of composite files: modal widths, runs, segments, cell dictionaries, diffs, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.trees import leaves

# Members of a record that a diff leaves out.
META = ("_match_signals", "_normalized_fields", "_field_confidence", "_issues", "_multidoc_documents")


def longest_run(rows: DataFrame, slack: int = 1) -> DataFrame:
    """sheet, mode, start, run_rows: the longest run of rows (sheet, idx, width) whose width is within ``slack`` of the
    sheet's most frequent one (of equals the wider); of equal runs the first. A window covers one sheet."""
    n = rows.groupBy("sheet", "width").agg(F.count("*").alias("n"))
    mode = n.groupBy("sheet").agg(F.max_by("width", F.struct("n", "width")).alias("mode"))
    sheet = Window.partitionBy("sheet").orderBy("idx")
    t = rows.join(mode, "sheet").withColumn("fits", F.abs(F.col("width") - F.col("mode")) <= slack).withColumn("row", F.row_number().over(sheet))
    t = t.withColumn("island", F.col("row") - F.sum(F.col("fits").cast("int")).over(sheet))
    runs = t.where("fits").groupBy("sheet", "mode", "island").agg(F.min("idx").alias("start"), F.count("*").alias("run_rows"))
    return runs.groupBy("sheet", "mode").agg(F.max_by(F.struct("start", "run_rows"), F.struct("run_rows", -F.col("start"))).alias("r")).select("sheet", "mode", "r.*")


def segments(pages: DataFrame, least_chars: int = 100) -> DataFrame:
    """file, segment, type, first_page, last_page, pages: a page (file, page, type, n_chars) of another type than the last
    strong page starts a segment; pages of fewer than ``least_chars`` characters are weak and stay where they are."""
    order = Window.partitionBy("file").orderBy("page")
    t = pages.withColumn("strong", F.when(F.col("n_chars") >= least_chars, F.col("type")))
    before = F.last("strong", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("new", F.coalesce(F.col("strong") != before, F.lit(False)).cast("int"))
    t = t.withColumn("segment", F.sum("new").over(order) + 1)
    out = t.groupBy("file", "segment").agg(F.max("strong").alias("type"), F.min("page").alias("a"), F.max("page").alias("b"), F.count("*").alias("n_pages"))
    span = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return out.select("file", "segment", "type", span.alias("pages"), "n_pages")


def cell_dictionary(cells: DataFrame, least_chars: int = 15, least_count: int = 5, most: int = 60) -> DataFrame:
    """cell, n, saved: the ``most`` repeated long cells (column cell) that save most characters as references."""
    n = cells.where(F.length("cell") >= least_chars).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return n.withColumn("saved", (F.col("n") - 1) * F.length("cell")).orderBy(F.desc("saved"), "cell").limit(most)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, path, change: added, removed or changed values of (id, path, value) tables; equal values give no row."""
    t = before.withColumnRenamed("value", "old").withColumn("_b", F.lit(True)).join(after.withColumnRenamed("value", "new").withColumn("_a", F.lit(True)), ["id", "path"], "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return t.select("id", "path", change.alias("change")).where("change IS NOT NULL")


def diff_records(records: DataFrame) -> DataFrame:
    """id, path, before, after: the leaves that differ between two JSON records (id, old, new), null where one has none or
    JSON's null. What is no object or array has no leaves. Paths are those of ``trees.leaves``, without the records' own
    notes; of two leaves with one path (keys with full stops) the one whose text is greater counts.

    Both records of a row are opened in place and only differing leaves leave it: nothing is shuffled or joined."""
    none = F.array().cast("array<struct<path:string,value:string>>")
    of = lambda c: F.map_from_entries(F.transform(last(F.array_sort(F.coalesce(leaves(F.col(c), META), none))), lambda x: F.struct(x["path"], F.struct(x["value"]))))  # noqa: E731  a leaf of null is a leaf

    def last(rows: Column) -> Column:
        return F.get(F.transform(F.array(rows), lambda r: F.filter(r, lambda x, i: ~F.coalesce(F.get(r, i + 1)["path"] == x["path"], F.lit(False)))), F.lit(0))

    t = records.select("id", of("old").alias("old"), of("new").alias("new"))
    both = F.map_entries(F.map_zip_with("old", "new", lambda _, a, b: F.struct(a.alias("old"), b.alias("new"))))
    changed = F.filter(both, lambda e: ~e["value"]["old"].eqNullSafe(e["value"]["new"]))
    return t.select("id", F.explode(changed).alias("c")).select("id", F.col("c.key").alias("path"), F.col("c.value.old.value").alias("before"), F.col("c.value.new.value").alias("after"))


def categorize_by(items: DataFrame, words: DataFrame, text: str = "text", preset: str = "preset") -> DataFrame:
    """Items (with a key ``id``) with ``category``: their ``preset`` unless it is blank or ``other``, else that of ``words`` (category,
    priority, word) with most words in the lower-cased text, ties to the smaller priority, ``other`` without any.

    The words come to every item as one array: a table of them is what people write by hand, a few hundred. A word counts
    once however often it is listed, an empty one never; null texts have none."""
    rule = words.where("word <> ''").groupBy("priority", "category").agg(F.collect_set("word").alias("words"))
    rules = rule.agg(F.array_sort(F.collect_list(F.struct("priority", "category", "words"))).alias("_rules"))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.transform("_rules", lambda r: F.struct(F.size(F.filter(r["words"], lambda w: F.contains(low, w))).alias("hits"), (-r["priority"]).alias("place"), r["category"].alias("category")))
    t = items.crossJoin(F.broadcast(rules)).withColumn("_best", F.array_max(hits))  # one row
    own = F.nullif(F.nullif(F.col(preset), F.lit("")), F.lit("other"))
    return t.withColumn("category", F.coalesce(own, F.when(F.col("_best.hits") > 0, F.col("_best.category")), F.lit("other"))).drop("_best", "_rules")


def categorize(items: DataFrame, text: str, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Adds ``category``: the rule with most keywords in the text, of equals the earlier; ``other`` without any."""
    low = F.lower(F.col(text))
    hits = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("hits"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, words) in enumerate(rules)]
    best = F.array_max(F.array(*hits))
    return items.withColumn("category", F.when(best["hits"] > 0, best["name"]).otherwise("other"))


def header_totals(items: DataFrame, rates: Sequence[int], near: float = 0.6) -> DataFrame:
    """doc, total, net, vat, rate: sums of lines (total with tax), the rate they imply snapped to the nearest of ``rates``
    within ``near``, else null."""
    t = items.groupBy("doc").agg(F.sum("total").alias("total"), F.sum(F.col("total") / (1 + F.col("rate") / 100)).alias("net"))
    t = t.withColumn("vat", F.col("total") - F.col("net"))
    implied = F.col("vat") / F.col("net") * 100
    nearest = F.array_min(F.array(*[F.struct(F.abs(implied - r).alias("off"), F.lit(r).alias("rate")) for r in rates]))
    return t.withColumn("rate", F.when(nearest["off"] <= near, nearest["rate"]))


def recall(pairs: DataFrame, *by: str) -> DataFrame:
    """by, expected, matched, recall of (by, expected, actual); 1 where nothing is expected."""
    t = pairs.groupBy(*by).agg(F.count("expected").alias("n_expected"), F.count_if(F.col("expected") == F.col("actual")).alias("n_matched"))
    return t.withColumn("recall", F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("n_matched") / F.col("n_expected")))


def recall_gate(found: DataFrame, limits: DataFrame, by: str = "by") -> DataFrame:
    """The recalls (by, field, recall, ...) with the least recall that is asked for (by, field, least; a null ``by`` holds for
    all) and whether they pass. A recall with limits of its own and for all must reach the greater; one without limit passes."""
    own = limits.where(F.col(by).isNotNull()).groupBy(by, "field").agg(F.max("least").alias("_own"))
    shared = limits.where(F.col(by).isNull()).groupBy("field").agg(F.max("least").alias("_all"))
    t = found.join(own, [by, "field"], "left").join(shared, "field", "left")
    least = F.greatest("_own", "_all")
    return t.select(*found.columns, least.alias("least"), (least.isNull() | (F.col("recall") >= least)).alias("passed"))
