"""Shared helpers: staged tables, vectorised text hashing, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``, else one set here, in local runs alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quarrylane-")
        spark.sparkContext.setCheckpointDir(base)
    return base


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it: lineage is cut and lost executors cost no rework. The
    shuffle files of the write go with it, as the plan that made them isn't run again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes the files of a table that ``staged`` returned, which nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores in front until no column of the frames is called so (case doesn't tell columns apart)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_side(table: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """A staged table of narrow rows as the side of a join: broadcast if it has ``most_rows`` or fewer, which is counted
    here, else as it is, for a shuffle join that adaptive execution may split."""
    return F.broadcast(table) if table.count() <= most_rows else table


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- Arrow text batches -------------------------------------------------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after the other, and len + 1 offsets into them; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def small_batches(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 18, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` text bytes and at most ``rows`` rows each (one row at least), so that memory doesn't
    follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(off, off[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


# ---- hashing ------------------------------------------------------------------------------------------------------

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 19, 1 << int(n - 1).bit_length())
        up, down = np.full(size, _R), np.full(size, _R_INV)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Polynomial hashes of all prefixes; ``span_hash`` gives that of any substring."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and where each text's words begin (len(off) values)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    begin = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = inside[1:-1][edge]
    last[edge - 1] = inside[1:-1][edge - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes (runs that cross texts included; callers cut those)."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    h = np.full(n, np.uint64(width))
    for k in range(width):
        h = mix(h * np.uint64(0x100000001B3) + words[k : k + n])
    return h


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, A-Z lower-cased; a text of fewer words is one shingle."""
    data, off = text_buffers(column)
    starts, ends, first = word_spans(data, off)
    words = span_hash(prefix_hash(data, lower=True), starts, ends)
    grams = window_hashes(words, width)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---- graphs -------------------------------------------------------------------------------------------------------


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step (Kiveris et al., 2014) over edges (a, b) with a > b."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = edges.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): label is the smallest id that links reach. Ids without an edge aren't returned.

    Alternating large-star and small-star: every step is a grouped minimum, combined before the shuffle, and a join, and
    the edges stay as many as at the start. The edges of one vertex share a join key (rows of two numbers, streamed past
    one another, never held together)."""
    edges = staged(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(60):
        edges = staged(_star(_star(edges, True), False), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components still change after 60 rounds")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(roots)


# ---- vectors ------------------------------------------------------------------------------------------------------


def finite_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each dimension in a list column: rows whose vector is there, isn't empty and
    holds finite numbers alone."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    for dim in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == dim))
        yield rows, values[(ends - sizes)[rows][:, None] + np.arange(dim)]


def usual_dimension(vectors: DataFrame, column: str = "x") -> tuple[int, int]:
    """Dimension that most of the packed vectors (8 bytes a component) have, of equally many the larger one, and how many
    have it; zeros for none."""
    sizes = vectors.groupBy(F.length(column).alias("bytes")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("bytes")).first()
    return (first["bytes"] // 8, first["n"]) if first else (0, 0)


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """(key, batches of its rows) for each run of equal values in a sorted column; batches must be read before the next."""
    state: dict[str, pa.RecordBatch | None] = {"rest": None}
    source = iter(batches)

    def following() -> pa.RecordBatch | None:
        rest, state["rest"] = state["rest"], None
        while rest is None or not rest.num_rows:
            rest = next(source, None)
            if rest is None:
                return None
        return rest

    def of(value: object) -> Iterator[pa.RecordBatch]:
        while (batch := following()) is not None:
            k = batch.column(key)
            same = pc.equal(k, pa.scalar(value, k.type)).to_numpy(zero_copy_only=False)
            to = len(same) if same.all() else int(np.argmin(same))
            if to:
                yield batch.slice(0, to)
            if to < len(same):
                state["rest"] = batch.slice(to)
                return

    while (batch := following()) is not None:
        state["rest"] = batch
        value = batch.column(key)[0].as_py()
        yield value, (own := of(value))
        for _ in own:  # what the caller left
            pass
