"""Quality rules with adaptive thresholds from mergeable quantile sketches, per language and source."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix, prefix_hash, small_batches, span_hash, staged, text_buffers, window_hashes, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
#: Metrics, and whether a low value is as odd as a high one.
METRICS = (("word_length", True), ("symbol_share", False), ("dup_line_share", False), ("repeat_share", False))


def count_texts(column: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """The counts of ``text_counts`` for a column of texts."""
    data, off = text_buffers(column)
    n = len(off) - 1
    starts, ends, first = word_spans(data, off)
    prefix = prefix_hash(data)
    words = span_hash(prefix, starts, ends)
    chars = np.zeros(len(data) + 1, np.int64)  # code points before each byte
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    in_words = np.zeros(len(words) + 1, np.int64)
    np.cumsum(chars[ends] - chars[starts], out=in_words[1:])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol[data], out=symbols[1:])

    doc_of_word = np.repeat(np.arange(n), np.diff(first))
    grams = window_hashes(words, window)
    whole = doc_of_word[: len(grams)] == doc_of_word[window - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    key = mix(grams[at] + mix(doc_of_word[at].astype(np.uint64)))
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    again = at[times[place] > 1]
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    repeat = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.cumsum(covered[:-1]) > 0, out=repeat[1:])

    # Lines end at \n and at the end of the text.
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    doc_of_line = np.searchsorted(off[1:], begin, "right")
    # A \n that ends its text opens an empty line, which has no word and never counts, so ties at a text's edge need no care.
    stop = np.empty(len(begin), np.int64)
    stop[:-1] = begin[1:] - 1
    stop[-1:] = len(data)
    next_is_doc = np.zeros(len(begin), bool)
    next_is_doc[:-1] = ~np.isin(begin[1:], breaks + 1)
    stop[next_is_doc] += 1
    stop = np.maximum(np.minimum(stop, len(data)), begin)
    has_word = np.searchsorted(starts, begin) < np.searchsorted(starts, stop)
    line, doc = np.flatnonzero(has_word), doc_of_line[has_word]
    key = mix(span_hash(prefix, begin[line], stop[line]) + mix(doc.astype(np.uint64)))
    _, first_of = np.unique(key, return_index=True)
    dup = np.ones(len(line), bool)
    dup[first_of] = False
    return {
        "n_lines": np.bincount(doc, minlength=n).astype(np.int64),
        "n_words": np.diff(first).astype(np.int64), "word_chars": in_words[first[1:]] - in_words[first[:-1]], "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": np.bincount(doc[dup], minlength=n).astype(np.int64), "n_repeat_words": repeat[first[1:]] - repeat[first[:-1]],
    }


def text_counts(docs: DataFrame, keep: Sequence[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep``, n_lines (lines with a word), n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word equal to an
    earlier line), n_repeat_words (words in 8-word windows that occur twice or more) of each whole text; null: none."""
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            counts = count_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(counts[c]) for c in ("n_lines", *COUNTS))], names=[*keep, "n_lines", *COUNTS])

    schema = type(docs.schema)(fields).add("n_lines", "long").add("n_words", "long").add("word_chars", "long").add("n_symbols", "long").add("n_dup_lines", "long").add("n_repeat_words", "long")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def quantile_sketch(values: DataFrame, keys: Sequence[str], metrics: Sequence[str], accuracy: float = 0.01) -> DataFrame:
    """A relative-error quantile sketch (Masson et al., 2019) of each metric for each group: rows of keys, metric, cell
    and n. Values up to 1e-3 fall into cell 0; cell i holds (1e-3 * g**(i-1), 1e-3 * g**i], g = (1 + a) / (1 - a).

    Two sketches merge by adding the counts of equal cells, which is all that the grouping does."""
    growth = (1 + accuracy) / (1 - accuracy)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.greatest(F.lit(0.0), F.ceil(F.log(F.col(m) / 1e-3) / float(np.log(growth)))).cast("int").alias("cell")) for m in metrics])
    return values.select(*keys, F.explode(pairs).alias("x")).where("x.cell IS NOT NULL").groupBy(*keys, "x.metric", "x.cell").agg(F.count("*").alias("n"))


def merge_sketches(sketch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "cell").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: Sequence[str], shares: Sequence[float], accuracy: float = 0.01) -> DataFrame:
    """A row for each group and metric: its count and the quantiles q0, q1, ... at ``shares``."""
    growth = (1 + accuracy) / (1 - accuracy)
    group = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = sketch.withColumn("upto", upto).withColumn("count", F.sum("n").over(group))
    value = F.when(F.col("cell") == 0, F.lit(0.0)).otherwise(1e-3 * F.pow(F.lit(growth), F.col("cell") - 0.5))
    picks = [F.min(F.when(F.col("upto") >= F.col("count") * share, value)).alias(f"q{i}") for i, share in enumerate(shares)]
    return s.groupBy(*keys, "metric").agg(F.first("count").alias("count"), *picks)


def sketch_spread(sketch: DataFrame, keys: Sequence[str], fence: float, accuracy: float = 0.01) -> DataFrame:
    """A row for each group and metric: its count, its median and its spread: the root mean square distance from the median
    of the values within ``fence`` of such distances over all values, so that odd ones don't hide each other. The width of
    the median's cell is the least, as a sketch tells no closer values apart."""
    growth = (1 + accuracy) / (1 - accuracy)
    group = Window.partitionBy(*keys, "metric")
    value = F.when(F.col("cell") == 0, F.lit(0.0)).otherwise(1e-3 * F.pow(F.lit(growth), F.col("cell") - 0.5))
    s = sketch.withColumn("upto", F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("count", F.sum("n").over(group)).withColumn("value", value)
    s = s.withColumn("median", F.min(F.when(F.col("upto") >= F.col("count") * 0.5, F.col("value"))).over(group)).withColumn("square", F.pow(F.col("value") - F.col("median"), 2))
    s = s.withColumn("all", F.sum(F.col("n") * F.col("square")).over(group) / F.col("count")).withColumn("near", F.when(F.col("square") <= fence**2 * F.col("all"), F.col("n")).otherwise(0))
    spread = F.sqrt(F.sum(F.col("near") * F.col("square")) / F.sum("near"))
    out = s.groupBy(*keys, "metric").agg(F.first("count").cast("double").alias("count"), F.first("median").alias("median"), spread.alias("spread"))
    return out.withColumn("spread", F.greatest("spread", 2 * accuracy * F.col("median")))


def adaptive_limits(sketch: DataFrame, fence: float, prior: float) -> DataFrame:
    """_lang, _source and for each metric a struct ``_metric`` of low and high, from a sketch by lang and source.

    The limits lie ``fence`` spreads off the median. A group's limits are mixed with its language's, and those with all documents', by weight: its number
    of documents against ``prior``. So a large group follows its own values, a small one mostly its language, and nothing jumps at
    any size."""
    limits = sketch.select("lang", "source", "metric").distinct()
    for depth, keys in enumerate((["lang", "source"], ["lang"], [])):
        q = sketch_spread(merge_sketches(sketch, keys), keys, fence)
        off = fence * F.col("spread")
        q = q.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("metric").alias("_metric"), F.col("count").alias(f"n{depth}"), (F.col("median") - off).alias(f"low{depth}"), (F.col("median") + off).alias(f"high{depth}"))
        on = F.col("metric") == F.col("_metric")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        limits = limits.join(q, on, "left").drop("_metric", *[f"_{k}" for k in keys])

    def mixed(side: str) -> Column:
        out = F.col(f"{side}2")
        for depth in (1, 0):
            own, n = F.col(f"{side}{depth}"), F.col(f"n{depth}")
            out = F.coalesce((n * own + prior * out) / (n + prior), own, out)
        return out

    sided = F.col("metric").isin(*[m for m, both in METRICS if both])
    limits = limits.select("lang", "source", "metric", F.struct(F.when(sided, mixed("low")).otherwise(F.lit(float("-inf"))).alias("low"), mixed("high").alias("high")).alias("at"))
    return limits.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*[F.max(F.when(F.col("metric") == m, F.col("at"))).alias(f"_{m}") for m, _ in METRICS])


def with_shares(counts: DataFrame) -> DataFrame:
    """The counts with the metrics' values: shares of symbols (of letters in words), of repeated lines (of lines with a word)
    and of repeated words, and the mean word length; 0 for none."""
    share = {"word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
    return counts.withColumns({name: F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0)) for name, (top, bottom) in share.items()})


def quality_verdicts(docs: DataFrame, fence: float = 3.5, prior: float = 50.0, least_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept.

    A document fails the base rules with fewer than ``least_words`` words or more than ``max_repeat`` percent of its
    words in repeated windows. The rest are held against the limits of their (lang, source) group (``adaptive_limits``), which
    the group's quantile sketch of documents that pass the base rules gives. A limit table row exists for each group, so
    verdicts come from a join and nothing is collected.

    Null and empty texts have no words and fail. Null lang and source are groups of their own. Repeated rows each get
    their verdict; an empty table gives none."""
    counts = staged(text_counts(docs), "quality-counts")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    d = with_shares(counts.withColumn("base_failed", failed))
    names = [m for m, _ in METRICS]
    sketch = staged(quantile_sketch(d.where(~F.col("base_failed")), ["lang", "source"], names), "quality-sketch")
    wide = staged(adaptive_limits(sketch, fence, prior), "quality-limits")
    out = d.join(wide, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m in names:
        inside = inside & (F.col(m) >= F.col(f"_{m}.low")) & (F.col(m) <= F.col(f"_{m}.high"))
    return out.select("doc_id", "lang", "source", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))
