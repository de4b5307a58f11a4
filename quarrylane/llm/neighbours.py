"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_parts, staged

NEAR = "array<struct<d:double,c:long>>"


def _near_lists(d: list[np.ndarray], c: list[np.ndarray]) -> pa.Array:
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(d), pa.float64()), pa.array(np.concatenate(c), pa.int64())], names=["d", "c"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, d)]), pa.int32()), flat)


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances; the same pair gives the same number whatever stands around it."""
    return np.stack([((row - b) ** 2).sum(axis=1) for row in a]) if len(a) else np.zeros((0, len(b)))


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, full: the vector as doubles) of the rows that can take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, full = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64) + 0.0  # one zero
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    full.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(full, pa.binary())], names=["vec_id", "full"])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).mapInArrow(run, "vec_id long, full binary")


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of a sorted key."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        last = int(np.searchsorted(k, k[-1]))
        t = pa.Table.from_batches([batch])
        if last:
            yield pa.concat_tables([*held, t.slice(0, last)])
            held = []
        elif held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.concat_tables(held)
            held = []
        held.append(t.slice(last))
    if held:
        yield pa.concat_tables(held)


class NeighbourGraph:
    """``vectors`` (vec_id, full), ``members`` (vec_id, id) naming the first row with an equal vector, and ``graph``
    (id, v: the vector as doubles, near: its nearest found, by distance) over distinct vectors."""

    def __init__(self, vectors: DataFrame, members: DataFrame, graph: DataFrame):
        self.vectors, self.members, self.graph = vectors, members, graph

    @classmethod
    def build(cls, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = 32, sample: int = 20, rounds: int | None = None, block: int = 512) -> NeighbourGraph:
        """NN-descent (Dong et al., 2011) over all rows of ``table``.

        Lists start from neighbours along two random projections, in blocks of ``block``. In each round every vector
        brings together the first ``sample`` of its list and up to ``sample`` vectors that list it; these are compared
        with one another (neighbours of neighbours), and better finds replace the tails of their lists. Rounds follow
        the logarithm of the number of vectors. Distances in the graph are of doubles, so that close
        copies keep their order. A range of a projection holds 2 * ``block`` rows or more, whatever the shuffle partitions.

        Rows whose id or vector is null, zero or holds a null or non-finite component take no part, nor do vectors of
        another dimension than most have (of equally many the larger one), to which no distance is defined. Equal
        vectors share a node. An empty table gives an empty graph."""
        spark = table.sparkSession
        n_parts = shuffle_parts(spark)
        vectors = staged(usable_vectors(table, id_col, vector_col), "nn-vectors")
        sizes = vectors.groupBy(F.length("full").alias("bytes")).agg(F.count("*").alias("n"))
        stats = sizes.orderBy(F.desc("n"), F.desc("bytes")).first() or {"n": 0, "bytes": 8}
        vectors = vectors.where(F.length("full") == stats["bytes"])
        keyed = vectors.select("vec_id", F.xxhash64("full").alias("k1"), F.xxhash64(F.lit(1), "full").alias("k2"))
        nodes = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"))
        members = staged(keyed.join(nodes, ["k1", "k2"]).select("vec_id", "id"), "nn-members")
        own = members.where("vec_id = id").select("id").distinct()
        dim = stats["bytes"] // 8
        rng = np.random.default_rng(5)
        directions = rng.normal(size=(dim, 2))

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    along = _stack(batch.column("full")) @ directions
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("full"), pa.array(along[:, 0].copy()), pa.array(along[:, 1].copy())], names=["id", "v", "p0", "p1"])

        base = vectors.withColumnRenamed("vec_id", "id").dropDuplicates(["id"]).join(own, "id", "left_semi").mapInArrow(project, "id long, v binary, p0 double, p1 double")
        base = staged(base, "nn-nodes")
        n_ranges = max(1, min(n_parts, base.count() // (2 * block)))

        def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done(t: pa.Table) -> pa.RecordBatch:
                x, ids = _stack(t.column("v").combine_chunks()), t.column("id").to_numpy()
                d = _distances(x, x)
                np.fill_diagonal(d, np.inf)
                k = min(degree, len(ids) - 1)
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                return pa.RecordBatch.from_arrays([pa.array(ids), _near_lists([d[i, b] for i, b in enumerate(best)], [ids[b] for b in best])], names=["id", "near"])

            held = None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                held = t if held is None else pa.concat_tables([held, t])
                while held.num_rows >= 2 * block:
                    yield done(held.slice(0, block))
                    held = held.slice(block)
            if held is not None and held.num_rows:
                yield done(held)

        parts = [base.repartitionByRange(n_ranges, p).sortWithinPartitions(p).select("id", "v").mapInArrow(in_blocks, f"id long, near {NEAR}") for p in ("p0", "p1")]
        first = parts[0].unionByName(parts[1]).groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
        cut = lambda near: F.slice(F.array_sort(F.array_distinct(near)), 1, degree)
        graph = staged(base.select("id", "v").join(first, "id").select("id", "v", cut(F.col("near")).alias("near")), "nn-graph")
        rounds = math.ceil(1.25 * math.log10(max(10, stats["n"]))) if rounds is None else rounds

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _grouped(batches, "centre"):
                centre, ids, worst = t.column("centre").to_numpy(), t.column("id").to_numpy(), t.column("worst").to_numpy()
                x = _stack(t.column("v").combine_chunks())
                cuts = [0, *(np.flatnonzero(np.diff(centre)) + 1).tolist(), len(centre)]
                us, cs, ds = [], [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    _, first = np.unique(ids[a:b], return_index=True)
                    first += a
                    d = _distances(x[first], x[first])
                    np.fill_diagonal(d, np.inf)
                    i, j = np.nonzero(d < worst[first][:, None])
                    us.append(ids[first[i]])
                    cs.append(ids[first[j]])
                    ds.append(d[i, j])
                if us:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(ds), pa.float64()), pa.array(np.concatenate(cs))], names=["id", "d", "c"])

        for turn in range(rounds):
            ahead = graph.select(F.col("id").alias("centre"), F.explode(F.slice("near", 1, sample)).alias("x")).select("centre", F.col("x.c").alias("id"))
            back = graph.select(F.explode("near").alias("x"), "id").select(F.col("x.c").alias("centre"), "id")
            pick = Window.partitionBy("centre").orderBy(F.xxhash64(F.lit(turn), "id", "centre"))
            back = back.withColumn("_k", F.row_number().over(pick)).where(F.col("_k") <= sample).drop("_k")
            worst = F.when(F.size("near") < degree, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"])
            groups = ahead.unionByName(back).join(graph.select("id", "v", worst.alias("worst")), "id")
            finds = groups.repartition(n_parts, "centre").sortWithinPartitions("centre").mapInArrow(meet, "id long, d double, c long")
            finds = finds.groupBy("id").agg(F.collect_set(F.struct("d", "c")).alias("new"))
            grown = graph.join(finds, "id", "left").select("id", "v", F.when(F.col("new").isNull(), F.col("near")).otherwise(cut(F.concat("near", "new"))).alias("near"))
            graph = staged(grown, "nn-graph")
        return cls(vectors, members, graph)

    def search(self, queries: DataFrame, k: int = 10, beam: int = 320, step: int = 64, hops: int = 14) -> DataFrame:
        """query_id, rank, vec_id, score: each query's ``k`` nearest found, itself left out. ``queries``: column query_id,
        ids of rows of the index.

        Greedy search: a query holds the ``beam`` nearest vectors met so far, from its own node on; in each hop the lists
        of the ``step`` nearest not yet followed are joined in, until all are followed or ``hops`` are done. All
        distances are measured in double precision, so the whole pool is ranked exactly; equal vectors are listed by id, ties
        go to the smaller id. Fewer than ``k`` other rows are all listed if their nodes are met."""
        n_parts = shuffle_parts(queries.sparkSession)
        q = queries.select("query_id").distinct().join(self.members.withColumnRenamed("vec_id", "query_id"), "query_id")
        nodes = q.select("id").distinct()
        state = "id long, v binary, pool array<struct<d:double,c:long,done:boolean>>, open int"
        pool_type = pa.list_(pa.struct([("d", pa.float64()), ("c", pa.int64()), ("done", pa.bool_())]))
        names = ["id", "v", "pool", "open"]

        start = self.graph.join(nodes, "id").select("id", "v", F.transform(F.concat(F.array(F.struct(F.lit(0.0).alias("d"), F.col("id").alias("c"))), "near"), lambda x: F.struct(x["d"], x["c"], (x["c"] == F.col("id")).alias("done"))).alias("pool"))
        now = staged(start.withColumn("open", F.size("pool") - 1), "nn-search")

        def hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _grouped(batches, "id"):
                q_id, kind = t.column("id").to_numpy(), t.column("kind").to_numpy()
                c, v, pool = t.column("c").to_numpy(), t.column("v"), t.column("pool")
                cuts = [0, *(np.flatnonzero(np.diff(q_id)) + 1).tolist(), len(q_id)]
                out = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    own = a + int(np.flatnonzero(kind[a:b] == 0)[0])
                    query, held = v[own].as_py(), pool[own].as_py()
                    new = a + np.flatnonzero(kind[a:b] == 1)
                    known = {x["c"] for x in held}
                    if len(new):
                        ids, first = np.unique(c[new], return_index=True)
                        keep = np.array([i not in known for i in ids.tolist()], bool)
                        ids, first = ids[keep], new[first[keep]]
                        if len(ids):
                            x = np.frombuffer(b"".join(v.take(pa.array(first)).to_pylist()), "<f8").reshape(len(ids), -1)
                            d = ((x - np.frombuffer(query, "<f8")) ** 2).sum(axis=1)
                            held = held + [{"d": float(p), "c": int(i), "done": False} for p, i in zip(d, ids, strict=True)]
                    held = sorted(held, key=lambda x: (x["d"], x["c"]))[:beam]
                    out.append((int(q_id[a]), query, held, sum(not x["done"] for x in held)))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pool_type), pa.array([o[3] for o in out], pa.int32())], names=names)

        for _ in range(hops):
            if now.where("open > 0").isEmpty():
                break
            todo = F.slice(F.filter("pool", lambda x: ~x["done"]), 1, step)
            marked = now.withColumn("todo", F.transform(todo, lambda x: x["c"]))
            held = marked.select("id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("c"), "v", F.transform("pool", lambda x: F.struct(x["d"], x["c"], (x["done"] | F.array_contains("todo", x["c"])).alias("done"))).alias("pool"))
            follow = marked.select("id", F.explode("todo").alias("node")).join(self.graph.select(F.col("id").alias("node"), F.transform("near", lambda x: x["c"]).alias("next")), "node")
            met = follow.select("id", F.explode("next").alias("c")).distinct().join(self.graph.select(F.col("id").alias("c"), "v"), "c")
            rows = held.unionByName(met.select("id", F.lit(1).alias("kind"), "c", "v", F.lit(None).cast("array<struct<d:double,c:long,done:boolean>>").alias("pool")))
            now = staged(rows.repartition(n_parts, "id").sortWithinPartitions("id", "kind").mapInArrow(hop, state), "nn-search")

        # Each node's first k + 1 rows of its whole pool: enough with the query itself left out.
        scored = now.select("id", F.explode("pool").alias("x")).select("id", F.col("x.c").alias("c"), F.sqrt("x.d").alias("score"))
        least = Window.partitionBy("id").orderBy("vec_id")
        rows = self.members.distinct().withColumn("_k", F.row_number().over(least)).where(F.col("_k") <= k + 1).select(F.col("id").alias("c"), "vec_id")
        best = Window.partitionBy("id").orderBy("score", "vec_id")
        listed = scored.join(rows, "c").withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k + 1).select("id", "vec_id", "score")
        out = q.join(listed, "id").where("query_id <> vec_id")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
