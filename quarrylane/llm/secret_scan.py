"""Secret scan: fixed patterns, and a battery of randomness tests over key-like strings. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from .common import staged

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs of one class are matched whole, so a least length inside the pattern keeps just the matches that pass it.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Key-like: a whole run of 20 or more of the base64 or base64url characters with a letter and a digit.
KEYLIKE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
KINDS = ("assign", "access", "hex", "random")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order of inference: name, pattern, alphabet in code order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "234567" + UPPER),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base36_upper", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64url", "^[0-9A-Za-z_-]+$", "-" + DIGITS + UPPER + "_" + LOWER),
    ("base64", "^[0-9A-Za-z+/_-]+$", "+-/" + DIGITS + UPPER + "_" + LOWER),
)
LENGTHS = (20, 32, 48, 64, 128)  # least length of each class
CELLS = 200  # of p-values, for the false-discovery estimate
BLOCK = 256  # matches of a text whose places are summed up together


def match_spans(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """Spans (start, kind, end) in code points of the leftmost non-overlapping matches; with ``group``, only of those
    in which that group has ``least`` characters or more. What lies between the matches gives their places."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    size = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x)) if group else found
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,ok:boolean>>)")
    moved = lambda x: x["gap"] + x["n"]

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["n"]).alias("end"), (x["size"] >= least).alias("ok"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def ends(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    gaps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda n, gap: F.struct(n.alias("n"), gap.alias("gap")))
    zipped = F.zip_with(gaps, size, lambda x, s: F.struct(x["n"].alias("n"), x["gap"].alias("gap"), s.alias("size")))
    # An array that grows is copied at each step: blocks of matches keep the copies short, and the blocks' starts come first.
    blocks = let(zipped, lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda i: F.slice(z, i * BLOCK + 1, F.lit(BLOCK))))
    totals = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + moved(x)))
    starts = lambda bs: F.aggregate(totals(bs), F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out")), ends, lambda acc: acc["out"])
    every = let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))))
    spans = F.filter(every, lambda x: x["ok"])
    plain = F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return F.when(text.rlike(pattern), plain).otherwise(F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)"))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Page's approximation)."""
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(table: DataFrame, value: str) -> DataFrame:
    """Adds ``encoding`` and ``p``, even between 0 and 1 for random strings: from the least p-value of chi-squared
    uniformity over the inferred alphabet, runs about its middle, and serial correlation. Small p: the string isn't
    random."""
    v = F.col(value)
    encoding, alphabet = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for name, pattern, letters in reversed(ENCODINGS[:-1]):
        encoding = F.when(v.rlike(pattern), F.lit(name)).otherwise(encoding)
        alphabet = F.when(v.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    t = table.withColumn("encoding", encoding).withColumn("_letters", alphabet)
    t = t.withColumn("_chars", F.split(v, "")).withColumn("_n", F.length(v).cast("double")).withColumn("_size", F.length("_letters").cast("double"))
    t = t.withColumn("_x", F.expr("transform(_chars, c -> cast(instr(_letters, c) - 1 as double))"))
    squares = F.expr(f"aggregate(array_distinct(_chars), 0D, (s, c) -> s + pow(_n - length(replace({value}, c, '')), 2))")
    chi = squares * F.col("_size") / F.col("_n") - F.col("_n")
    chi_z = (chi - (F.col("_size") - 1)) / F.sqrt(2 * (F.col("_size") - 1) * (F.col("_n") - 1) / F.col("_n"))
    t = t.withColumn("_p1", _tail(chi_z))
    t = t.withColumn("_high", F.expr("transform(_x, x -> x >= _size / 2)")).withColumn("_n1", F.expr("cast(size(filter(_high, x -> x)) as double)")).withColumn("_n2", F.col("_n") - F.col("_n1"))
    t = t.withColumn("_runs", F.expr("1D + size(filter(zip_with(slice(_high, 1, size(_high) - 1), slice(_high, 2, size(_high) - 1), (a, b) -> a <> b), x -> x))"))
    both = 2 * F.col("_n1") * F.col("_n2")
    spread = F.sqrt(both * (both - F.col("_n")) / (F.col("_n") * F.col("_n") * (F.col("_n") - 1)))
    runs_z = F.when((F.col("_n1") > 0) & (F.col("_n2") > 0) & (spread > 0), F.abs(F.col("_runs") - both / F.col("_n") - 1) / spread).otherwise(F.lit(12.0))
    t = t.withColumn("_p2", F.least(F.lit(1.0), 2 * _tail(runs_z)))
    t = t.withColumn("_mean", F.expr("aggregate(_x, 0D, (s, x) -> s + x) / _n"))
    t = t.withColumn("_var", F.expr("aggregate(_x, 0D, (s, x) -> s + (x - _mean) * (x - _mean))"))
    t = t.withColumn("_cov", F.expr("aggregate(zip_with(slice(_x, 1, size(_x) - 1), slice(_x, 2, size(_x) - 1), (a, b) -> (a - _mean) * (b - _mean)), 0D, (s, x) -> s + x)"))
    serial_z = F.when(F.col("_var") > 0, F.abs(F.col("_cov") / F.col("_var") + 1 / F.col("_n")) * F.sqrt("_n")).otherwise(F.lit(12.0))
    t = t.withColumn("_p3", F.least(F.lit(1.0), 2 * _tail(serial_z)))
    return t.withColumn("p", 1.0 - F.pow(1.0 - F.least("_p1", "_p2", "_p3"), F.lit(3.0))).drop(*[c for c in t.columns if c.startswith("_")])


def _length_class(n: Column) -> Column:
    return sum([(n >= least).cast("int") for least in LENGTHS[1:]], F.lit(0))


def _cell(p: Column) -> Column:
    return F.least(F.lit(CELLS - 1), F.floor(p * CELLS)).cast("int")


def discovery_limits(tested: DataFrame, level: float = 0.1) -> dict[int, int]:
    """For each length class, the least cell of p-values from which on strings are taken for random ones.

    A discovery is a random string, a false one a string that isn't random but passes the battery. Random strings spread
    evenly over p and others crowd near 0, so the share of random strings in a class follows from its strings above one
    half (Storey, 2002), and the false discoveries from a cell on are what stands there beyond their even share. The
    least cell at which these are ``level`` of the discoveries or fewer is the limit. Short strings give the tests less
    power, so more of the others reach high p in their class, which pushes its limit up. A class without such a cell has
    no limit and no discoveries. Only counts of cells are used: 200 for each of five classes, over all strings."""
    cells = tested.groupBy(_length_class(F.col("n")).alias("cls"), _cell(F.col("p")).alias("cell")).agg(F.count("*").alias("k"))
    group = Window.partitionBy("cls")  # 200 cells at most
    above = F.sum("k").over(group.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumn("above", above).withColumn("high", F.sum(F.when(F.col("cell") >= CELLS // 2, F.col("k")).otherwise(0)).over(group)).withColumn("all", F.sum("k").over(group))
    random = F.least(F.col("all"), 2 * F.col("high"))
    false = F.col("above") - random * (1 - F.col("cell") / float(CELLS))
    found = cells.where(false <= level * F.col("above")).groupBy("cls").agg(F.min("cell").alias("limit"))
    return {r["cls"]: r["limit"] for r in found.collect()}  # five rows at most


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and, for each whole text: base (spans of the three patterns), added (spans of the battery), both
    arrays of (start, kind, end) in code points with kind an index of ``KINDS``.

    Key-like strings outside base spans go through the battery; those that it discovers to be random are added. A null text is empty. Each row is judged by itself, so repeated rows get equal results; an
    empty table gives no rows. Spans are per row: nothing is grouped by document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(match_spans(text, ASSIGN, 0, 2, 6), match_spans(text, ACCESS, 1), match_spans(text, HEX, 2)))
    keys = match_spans(text, KEYLIKE, 3)
    d = docs.select("doc_id", text.alias("text")).select("doc_id", base.alias("base"), keys.alias("keys"), "text")
    free = F.filter("keys", lambda k: ~F.exists("base", lambda b: (b["start"] < k["end"]) & (k["start"] < b["end"])))
    named = F.transform(free, lambda k: F.struct(k["start"], k["kind"], k["end"], F.substring(F.col("text"), k["start"] + 1, k["end"] - k["start"]).alias("value")))
    d = staged(d.select("doc_id", "base", named.alias("keys"), F.monotonically_increasing_id().alias("row")), "secret-spans")
    some = d.where(F.size("keys") > 0).select("row", F.explode("keys").alias("k")).select("row", "k.start", "k.kind", "k.end", F.col("k.value").alias("value"), F.length("k.value").alias("n"))
    tested = staged(battery(some, "value").drop("value"), "secret-tests")
    limits = discovery_limits(tested)
    limit = F.lit(CELLS)
    for cls, at in limits.items():
        limit = F.when(_length_class(F.col("n")) == cls, F.lit(at)).otherwise(limit)
    added = tested.where(_cell(F.col("p")) >= limit).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    return d.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
