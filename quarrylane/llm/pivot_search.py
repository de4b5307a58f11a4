"""Exact search for the largest inner products, by elimination over a table of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import finite_vectors, runs, shuffle_parts, staged, usual_dimension

SCALE = 256
LONG = (1 << 63) - 1
QUERIES = "row long, query_id long, home long, tau double, x binary, d binary"


def scaled_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x: packed longs floor(256 * c)) of the rows with an id whose vector holds finite components alone. A
    component that passes 62 bits has no long and leaves its row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in finite_vectors(batch.column("vector")):
                with np.errstate(over="ignore"):
                    x = np.floor(m * SCALE)
                fits = (np.abs(x) < 2.0**62).all(axis=1)
                packed = [r.tobytes() for r in x[fits].astype("<i8")]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows[fits])), pa.array(packed, pa.binary())], names=["vec_id", "x"])

    usable = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id IS NOT NULL")
    return usable.mapInArrow(run, "vec_id long, x binary")


def _stack(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _table(schema: str, *columns: object) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """The origin, whose distance is a vector's length, then rows each farthest from those before it."""
    picked = [np.zeros(sample.shape[1])]
    near = np.full(len(sample), np.inf)
    while len(picked) < n:
        near = np.minimum(near, np.sqrt(((sample - picked[-1]) ** 2).sum(axis=1)))
        if not len(near) or near.max() == 0:
            break
        picked.append(sample[int(near.argmax())])
    return np.stack(picked)


def _apart(low: np.ndarray, high: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Largest lower bound on the distance of each query (rows of ``d``) to each of the rows or blocks whose distances to
    the pivots lie between ``low`` and ``high``."""
    out = np.zeros((len(d), len(low)))
    for p in range(d.shape[1]):
        own = d[:, p][:, None]
        np.maximum(out, np.maximum(low[:, p] - own, own - high[:, p]), out=out)
    return out


class _Block:
    """Rows of a block in a task; ``best`` gives the rows that may be among a query's k best."""

    def __init__(self, batch: pa.RecordBatch, pivots: int):
        self.number = batch.column("block")[0].as_py()
        self.ids = np.frombuffer(batch.column("ids")[0].as_py(), "<i8")
        self.x = np.frombuffer(batch.column("x")[0].as_py(), "<i8").reshape(len(self.ids), -1)
        self.d = np.frombuffer(batch.column("d")[0].as_py(), "<f8").reshape(len(self.ids), pivots)
        self.wide = self.x.astype(np.float64)

    def scores(self, rows: np.ndarray, x: np.ndarray, length: float) -> np.ndarray:
        """Exact inner products: in doubles while no sum can pass 53 bits, in Python's integers beyond; those that pass a
        long count as its bound."""
        if length * float(self.d[rows, 0].max(initial=0)) < 2.0**52:
            return (self.wide[rows] @ x.astype(np.float64)).astype(np.int64)
        exact = [sum(a * b for a, b in zip(r, x.tolist(), strict=True)) for r in self.x[rows].tolist()]
        return np.array([max(-LONG, min(LONG, s)) for s in exact], np.int64)

    def best(self, query_id: int, x: np.ndarray, d: np.ndarray, apart: np.ndarray, tau: float, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best other rows whose score reaches ``tau``, best first: rows follow in the order of
        their bounds, until the bound falls below the k-th score found."""
        # <q, x> = (|q|**2 + |x|**2 - |q - x|**2) / 2; the slack covers the rounding of distances.
        squares = d[0] ** 2 + self.d[:, 0] ** 2
        bound = (squares - apart**2) / 2 + 1e-9 * (squares + d.max() ** 2)
        rows = np.flatnonzero((bound >= tau) & (self.ids != query_id))
        rows = rows[np.argsort(-bound[rows], kind="stable")]
        ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(rows), step):
            if bound[rows[a]] < tau:
                break
            part = rows[a : a + step]
            ids, found = np.concatenate([ids, self.ids[part]]), np.concatenate([found, self.scores(part, x, float(d[0]))])
            order = np.lexsort((ids, -found))[:k]
            ids, found = ids[order], found[order]
            if len(found) == k:
                tau = max(tau, float(found[-1]))
        return ids, found


class PivotIndex:
    """``blocks`` of rows that lie near one another, each with its rows' distances to the pivots and their range (``low``,
    ``high``), and ``places`` (vec_id, block, row)."""

    def __init__(self, blocks: DataFrame, places: DataFrame, pivots: int, block_rows: int):
        self.blocks, self.places, self.pivots, self.block_rows = blocks, places, pivots, block_rows

    @classmethod
    def build(cls, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 48, sample_rows: int = 4096, block_rows: int = 2048) -> PivotIndex:
        """Every row goes into the table; only the choice of the ``pivots`` looks at a sample (``sample_rows`` rows with the
        least hashes, fetched to the driver), which decides how much is skipped and never what is found. Rows are sorted by
        nearest pivot, distance to it and id, and packed into blocks in that order, so equal vectors spread over blocks.

        Rows without id, and rows whose vector is null, empty or holds a null or non-finite component, take no part, nor do
        vectors of another dimension than most have (of equally many the larger), to which no product is defined. Zero
        vectors do. Rows that repeat id and vector count once; an id with several vectors has a row for each. An empty table
        gives an empty index."""
        rows = staged(scaled_rows(table, id_col, vector_col), "pivot-rows")
        dim, n = usual_dimension(rows)
        rows = rows.where(F.length("x") == 8 * dim)
        sample = [r["x"] for r in rows.select("x").orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(sample_rows).collect()]
        chosen = farthest_first(np.frombuffer(b"".join(sample), "<i8").reshape(len(sample), -1).astype(np.float64), pivots + 1) if sample else np.zeros((1, 0))
        m = len(chosen)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    part = batch.slice(a, 4096)
                    x = _stack(part.column("x"), "<i8").astype(np.float64)
                    d = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in chosen], axis=1)
                    at = d[:, 1:].argmin(axis=1) if m > 1 else np.zeros(len(x), int)
                    near = d[np.arange(len(x)), at + (m > 1)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in d], pa.binary()), pa.array(at, pa.int32()), pa.array(near)], names=["vec_id", "x", "d", "cell", "near"])

        packed = "block long, ids binary, x binary, d binary, low binary, high binary"

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 24
            held: list[tuple[int, bytes, bytes]] = []
            last = None

            def done() -> pa.RecordBatch:
                d = np.frombuffer(b"".join(h[2] for h in held), "<f8").reshape(len(held), m)
                return _table(packed, [number], [np.array([h[0] for h in held], "<i8").tobytes()], [b"".join(h[1] for h in held)], [d.tobytes()], [d.min(axis=0).tobytes()], [d.max(axis=0).tobytes()])

            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "x", "d")), strict=True):
                    if row[:2] == last:
                        continue
                    last = row[:2]
                    held.append(row)
                    if len(held) == block_rows:
                        yield done()
                        held, number = [], number + 1
            if held:
                yield done()

        n_ranges = max(1, min(max(shuffle_parts(table.sparkSession), n // (64 * block_rows)), n // block_rows))
        order = ["cell", "near", "vec_id", "x"]
        measured = rows.mapInArrow(measure, "vec_id long, x binary, d binary, cell int, near double")
        # Rows that repeat share all sort keys but the vector's bytes, so they meet in one range.
        blocks = staged(measured.repartitionByRange(n_ranges, "cell", "near", "vec_id").sortWithinPartitions(*order).select("vec_id", "x", "d").mapInArrow(pack, packed), "pivot-blocks")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    own = np.frombuffer(ids, "<i8")
                    yield _table("vec_id long, block long, row int", own, np.full(len(own), block), np.arange(len(own)))

        return cls(blocks, blocks.select("block", "ids").mapInArrow(place, "vec_id long, block long, row int"), m, block_rows)

    def search(self, queries: DataFrame, k: int = 5, page: int = 512) -> DataFrame:
        """query_id, rank, vec_id, score: each query's ``k`` largest inner products, ties to the smaller id, rows with its
        own id left out; fewer if there are fewer. ``queries``: column query_id, ids of rows of the index (others and
        nulls give nothing; an id with several vectors gets a list for each, under its id).

        A query is first answered within its own block: its k-th score there bounds what is worth looking at. Then blocks,
        in pages of summaries, are skipped whose distances to the pivots leave no score that high, and in the blocks left,
        rows are measured in the order of their own bounds until no later one can enter. So nothing is lost: a bound that
        skips nothing only costs time, at worst that of measuring the queries against all rows, block by block."""
        m, parts = self.pivots, shuffle_parts(queries.sparkSession)
        n_blocks = self.blocks.count()
        n_parts = max(parts, n_blocks // 8)
        content = self.blocks.select("block", F.lit(0).alias("kind"), "ids", "x", "d")
        blank = F.lit(None).cast("binary")
        asked = self.places.join(queries.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id")
        keep = "row long, query_id long, home long, tau double, x binary, d binary, found_ids binary, found binary"

        def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, own in runs(batches, "block"):
                block = None
                for batch in own:
                    if block is None:
                        block, batch = _Block(batch, m), batch.slice(1)
                    for i in batch.column("row").to_pylist():
                        apart = _apart(block.d, block.d, block.d[i : i + 1])[0]
                        ids, found = block.best(int(block.ids[i]), block.x[i], block.d[i], apart, -np.inf, k)
                        tau = float(found[-1]) if len(found) == k else -np.inf
                        yield _table(keep, [(block.number << 16) + i], [int(block.ids[i])], [block.number], [tau], [block.x[i].tobytes()], [block.d[i].tobytes()], [ids.tobytes()], [found.tobytes()])

        meeting = content.withColumn("row", F.lit(None).cast("int")).unionByName(asked.select("block", F.lit(1).alias("kind"), blank.alias("ids"), blank.alias("x"), blank.alias("d"), "row"))
        seeds = staged(meeting.repartition(n_parts, "block").sortWithinPartitions("block", "kind", "row").mapInArrow(at_home, keep), "pivot-seeds")

        group = "rows binary, query_ids binary, homes binary, taus binary, xs binary, ds binary"

        def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    yield _table(group, *[[part.column(c).to_numpy().tobytes()] for c in ("row", "query_id", "home", "tau")], *[[b"".join(part.column(c).to_pylist())] for c in ("x", "d")])

        teams = seeds.select("row", "query_id", "home", "tau", "x", "d").mapInArrow(grouped, group)
        n_pages = max(1, n_blocks // page)
        summaries = self.blocks.select(F.pmod(F.xxhash64("block"), F.lit(n_pages)).alias("page"), F.lit(0).alias("kind"), "block", "low", "high")
        sent = teams.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long")))).withColumn("kind", F.lit(1))
        names = [f.split(" ")[0] for f in group.split(", ")]

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, own in runs(batches, "page"):
                blocks: list[int] = []
                ranges: list[tuple[bytes, bytes]] = []
                low = high = None
                for batch in own:
                    for row in batch.to_pylist():
                        if row["kind"] == 0:
                            blocks.append(row["block"])
                            ranges.append((row["low"], row["high"]))
                            continue
                        if low is None:
                            low, high = (np.frombuffer(b"".join(r[i] for r in ranges), "<f8").reshape(len(blocks), m) for i in (0, 1))
                        rows, ids, homes = (np.frombuffer(row[c], "<i8") for c in ("rows", "query_ids", "homes"))
                        tau, d = np.frombuffer(row["taus"], "<f8"), np.frombuffer(row["ds"], "<f8").reshape(len(ids), m)
                        x = np.frombuffer(row["xs"], "<i8").reshape(len(ids), -1)
                        squares = d[:, :1] ** 2 + high[:, 0] ** 2
                        bound = (squares - _apart(low, high, d) ** 2) / 2 + 1e-9 * (squares + d.max(axis=1)[:, None] ** 2)
                        for j, block in enumerate(blocks):
                            on = (bound[:, j] >= tau) & (homes != block)
                            if on.any():
                                yield _table(f"block long, {group}", [block], *[[c[on].tobytes()] for c in (rows, ids, homes, tau, x, d)])

        pages = summaries.select("*", *[blank.alias(c) for c in names]).unionByName(sent.select("page", "kind", F.lit(None).cast("long").alias("block"), blank.alias("low"), blank.alias("high"), *names))
        calls = pages.repartition(min(parts, n_pages * 4), "page").sortWithinPartitions("page", "kind").mapInArrow(reach, f"block long, {group}")

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, own in runs(batches, "block"):
                block = None
                for batch in own:
                    if block is None:
                        block, batch = _Block(batch, m), batch.slice(1)
                    for i in range(batch.num_rows):
                        call = {c: batch.column(c)[i].as_py() for c in names}
                        rows, ids = np.frombuffer(call["rows"], "<i8"), np.frombuffer(call["query_ids"], "<i8")
                        tau, d = np.frombuffer(call["taus"], "<f8"), np.frombuffer(call["ds"], "<f8").reshape(len(ids), m)
                        x = np.frombuffer(call["xs"], "<i8").reshape(len(ids), -1)
                        out: list[tuple[np.ndarray, ...]] = []
                        for a in range(0, len(ids), 64):
                            apart = _apart(block.d, block.d, d[a : a + 64])
                            for q in range(a, min(a + 64, len(ids))):
                                found = block.best(int(ids[q]), x[q], d[q], apart[q - a], float(tau[q]), k)
                                out.append((np.full(len(found[0]), rows[q]), np.full(len(found[0]), ids[q]), *found))
                        yield _table("row long, query_id long, vec_id long, score long", *[np.concatenate([o[j] for o in out]) for j in range(4)])

        calling = content.select("*", *[blank.alias(c) for c in names]).unionByName(calls.select("block", F.lit(1).alias("kind"), blank.alias("ids"), blank.alias("x"), blank.alias("d"), *names))
        away = calling.repartition(n_parts, "block").sortWithinPartitions("block", "kind").mapInArrow(visit, "row long, query_id long, vec_id long, score long")

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ids, found = np.frombuffer(r["found_ids"], "<i8"), np.frombuffer(r["found"], "<i8")
                    yield _table("row long, query_id long, vec_id long, score long", np.full(len(ids), r["row"]), np.full(len(ids), r["query_id"]), ids, found)

        home = seeds.select("row", "query_id", "found_ids", "found").mapInArrow(unpack, "row long, query_id long, vec_id long, score long")
        best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        return home.unionByName(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
