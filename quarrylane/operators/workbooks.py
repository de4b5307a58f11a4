"""Sheets as rows (sheet, idx, cells: array of strings): previews, runs, repeated cells, column mapping and merged items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .layout import spread

# Names under which an item may keep its code, name, quantity and price.
ITEM_KEYS = (
    ("code", "article", "artikul", "артикул", "код", "sku"),
    ("name", "title", "description", "наименование", "товар", "product"),
    ("quantity", "qty", "count", "кол_во", "количество"),
    ("price", "unit_price", "цена", "total", "sum", "amount", "сумма"),
)
MOST_ITEMS = 1000


def filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))


def preview(rows: DataFrame, sheets: int = 20, lines: int = 300, columns: int = 60) -> DataFrame:
    """The first ``lines`` rows and ``columns`` cells of the first ``sheets`` sheets."""
    first = rows.select("sheet").distinct().orderBy("sheet").limit(sheets)
    w = Window.partitionBy("sheet").orderBy("idx")
    t = rows.join(F.broadcast(first), "sheet", "left_semi").withColumn("_k", F.row_number().over(w))  # at most ``sheets`` rows
    return t.where(F.col("_k") <= lines).select("sheet", "idx", F.slice("cells", 1, columns).alias("cells"))


def longest_filled_run(rows: DataFrame) -> DataFrame:
    """sheet, start, run_rows: the longest run of rows between separators (rows with one filled cell or none), of equals the
    first."""
    w = Window.partitionBy("sheet").orderBy("idx")
    t = rows.withColumn("sep", (filled(F.col("cells")) <= 1).cast("int")).withColumn("part", F.sum("sep").over(w)).where("sep = 0")
    runs = t.groupBy("sheet", "part").agg(F.min("idx").alias("start"), F.count("*").alias("run_rows"))
    return runs.groupBy("sheet").agg(F.max_by(F.struct("start", "run_rows"), F.struct("run_rows", -F.col("start"))).alias("r")).select("sheet", "r.*")


def regions(rows: DataFrame, least_rows: int = 4, least_width: int = 3, reach: int = 2) -> DataFrame:
    """file, sheet, header_row, data_start, data_rows, width, header: every table of the sheets of files (file, sheet, idx,
    cells, idx from 0 without gaps).

    A table is a run of rows with two filled cells or more. Its header is the first of its widest rows, and what stands above
    that is no part of it; but if the row before, with ``reach`` separators between them at most, is wider than the whole run, that
    row is the header and all of the run is data. Runs with fewer than ``least_rows`` rows of data, or narrower than
    ``least_width``, are none. A sheet has some million rows at most; its runs are found in one window."""
    w = Window.partitionBy("file", "sheet").orderBy("idx")
    t = rows.withColumn("_f", filled(F.col("cells"))).withColumn("_part", F.sum((F.col("_f") <= 1).cast("int")).over(w)).where("_f > 1")
    row = F.struct("_f", "idx", "cells")
    found = t.groupBy("file", "sheet", "_part").agg(F.min("idx").alias("_from"), F.max("idx").alias("_to"), F.max_by(row, F.struct("_f", -F.col("idx"))).alias("_head"), F.max_by(row, "idx").alias("_last"))
    before = Window.partitionBy("file", "sheet").orderBy("_part")
    above = F.when(F.col("_part") - F.lag("_part").over(before) <= reach, F.lag("_last").over(before))
    found = found.withColumn("_above", above).withColumn("_use", F.coalesce(F.col("_above._f") > F.col("_head._f"), F.lit(False)))
    head = F.when(F.col("_use"), F.col("_above")).otherwise(F.col("_head"))
    found = found.select("file", "sheet", head["idx"].alias("header_row"), F.when(F.col("_use"), F.col("_from")).otherwise(F.col("_head.idx") + 1).alias("data_start"), "_to", F.col("_head._f").alias("width"), head["cells"].alias("header"))
    found = found.withColumn("data_rows", F.col("_to") + 1 - F.col("data_start")).drop("_to")
    return found.where((F.col("width") >= least_width) & (F.col("data_rows") >= least_rows)).select("file", "sheet", "header_row", "data_start", "data_rows", "width", "header")


def region_samples(found: DataFrame, rows: DataFrame, n: int = 2) -> DataFrame:
    """The regions with ``samples``: their first ``n`` rows of data."""
    at = found.select("file", "sheet", "data_start", F.explode(F.sequence(F.col("data_start"), F.least(F.col("data_start") + n, F.col("data_start") + F.col("data_rows")) - 1)).alias("idx"))
    cells = at.join(rows.select("file", "sheet", "idx", "cells"), ["file", "sheet", "idx"]).groupBy("file", "sheet", "data_start").agg(F.array_sort(F.collect_list(F.struct("idx", "cells"))).alias("_s"))
    return found.join(cells, ["file", "sheet", "data_start"], "left").withColumn("samples", F.transform("_s", lambda s: s["cells"])).drop("_s")


def workbook_report(found: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` largest regions of each file, numbered from 0 by falling rows of data (then by sheet and place), with
    ``total_rows`` of all its regions."""
    files = Window.partitionBy("file")
    order = files.orderBy(F.desc("data_rows"), "sheet", "data_start")
    t = found.withColumn("total_rows", F.sum("data_rows").over(files)).withColumn("index", F.row_number().over(order) - 1)
    return t.where(F.col("index") < most)


def choice_verdict(report: DataFrame, chosen: DataFrame) -> DataFrame:
    """file, verdict of the regions (file, index) chosen from a report: ``skipped_bigger`` if one left out has more rows of
    data than any chosen, ``split_table`` if one left out is as wide as a chosen one of its sheet, else ``ok``. Files of which none
    is chosen aren't judged."""
    t = report.join(chosen.select("file", "index").distinct().withColumn("_on", F.lit(True)), ["file", "index"], "left").withColumn("_on", F.coalesce("_on", F.lit(False)))
    t = t.withColumn("_twin", F.max("_on").over(Window.partitionBy("file", "sheet", "width")))
    rows = lambda on: F.max(F.when(on, F.col("data_rows")))
    one = t.groupBy("file").agg(rows(F.col("_on")).alias("taken"), rows(~F.col("_on")).alias("left"), F.max(~F.col("_on") & F.col("_twin")).alias("split")).where("taken IS NOT NULL")
    return one.select("file", F.when(F.col("left") > F.col("taken"), "skipped_bigger").when(F.col("split"), "split_table").otherwise("ok").alias("verdict"))


def with_references(rows: DataFrame, least_chars: int = 15, least_count: int = 5, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """(rows with repeated long cells as ``@N``, legend of ref and cell): the ``most`` cells that save most characters, by what
    they save. The legend has at most ``most`` rows."""
    cells = rows.select(F.explode("cells").alias("cell")).where(F.length("cell") >= least_chars)
    n = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    best = n.withColumn("saved", (F.col("n") - 1) * F.length("cell")).orderBy(F.desc("saved"), "cell").limit(most)
    legend = best.select(F.concat(F.lit("@"), F.row_number().over(Window.orderBy(F.desc("saved"), "cell"))).alias("ref"), "cell")
    entries = F.broadcast(legend.agg(F.map_from_entries(F.collect_list(F.struct("cell", "ref"))).alias("_refs")))  # one row
    swap = F.transform("cells", lambda c: F.coalesce(F.try_element_at("_refs", c), c))
    return rows.crossJoin(entries).select("sheet", "idx", swap.alias("cells")), legend


def mapped(cells: Column, columns: dict[str, int]) -> Column:
    """A row as a record of fields by the number of their column (from 0); blank cells are left out. Empty for blank rows."""
    pairs = [F.struct(F.lit(f).alias("key"), F.trim(F.get(cells, F.lit(i))).alias("value")) for f, i in columns.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def mapping_verdict(items: DataFrame, by: str, rows: Column, width: Column, required: Sequence[str], numeric: Sequence[str], columns: int, least: float = 0.7) -> DataFrame:
    """by, verdict of a table's mapped items (column item): ``few`` (under five), ``gaps`` (a required field in fewer than
    ``least`` of them), ``words`` (a numeric field that is no number in as many), ``uncovered`` (under nine tenths of the
    region's rows), ``thin`` (fewer columns than half the width, two at least), else ``ok``."""
    at = lambda f: F.try_element_at("item", F.lit(f))
    share = lambda c: F.count_if(c) / F.count("*")
    number = lambda f: F.coalesce(F.replace(F.regexp_replace(at(f), r"\s", ""), F.lit(","), F.lit(".")).try_cast("double").isNotNull(), F.lit(False))
    t = items.where(F.size(F.map_keys("item")) > 0).groupBy(by).agg(
        F.count("*").alias("n"), F.min(rows).alias("rows"), F.min(width).alias("width"), F.least(F.lit(1.0), *[share(at(f).isNotNull()) for f in required]).alias("full"), F.least(F.lit(1.0), *[share(number(f)) for f in numeric]).alias("numbers"),
    )
    thin = F.lit(columns) < F.greatest(F.lit(2), F.floor(F.col("width") * 0.5))
    verdict = F.when(F.col("n") < 5, "few").when(F.col("full") < least, "gaps").when(F.col("numbers") < least, "words").when(F.col("n") < 0.9 * F.col("rows"), "uncovered").when(thin, "thin").otherwise("ok")
    return t.select(by, verdict.alias("verdict"))


def item_key(item: Column) -> Column:
    """Code, name, quantity and price of an item, each under the first of its names that is filled, trimmed, squeezed, in
    lower case, joined by a bar; null without any."""
    pick = lambda names: F.coalesce(*[F.nullif(F.lower(F.trim(F.regexp_replace(F.try_element_at(item, F.lit(n)), r"(?U)\s+", " "))), F.lit("")) for n in names])
    return F.nullif(F.concat_ws("|", *[pick(names) for names in ITEM_KEYS]), F.lit(""))


def merge_chunks(items: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """doc, line_no, item of items (doc, chunk, pos, item) that chunks of a document gave: in their order, without later
    repeats of a key, ``most`` at most. Items without a key all stay. Both windows sort the rows of one deal by documents."""
    t = spread(items, "doc").withColumn("_key", item_key(F.col("item")))
    seen = F.row_number().over(Window.partitionBy("doc", "_key").orderBy("chunk", "pos"))
    t = t.withColumn("_n", seen).where((F.col("_n") == 1) | F.col("_key").isNull())
    line = F.row_number().over(Window.partitionBy("doc").orderBy("chunk", "pos"))
    return t.withColumn("line_no", line).where(F.col("line_no") <= most).select("doc", "line_no", "item")


def merged_confidence(header: Column, failed: Column) -> Column:
    """A tenth less for each chunk that failed, not below 0."""
    return F.greatest(F.lit(0.0), header - 0.1 * failed)
