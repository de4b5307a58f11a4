"""Similarity join of whole texts by the Jaccard index of their word shingles, with signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, fresh, mix, shingle_sets, shuffle_parts, small_batches, staged

#: Tokens of a set that travel to find candidates: its 40 smallest hashes.
SKETCH = 40
#: Hot tokens, the smallest hashes first, by which a set in a large group is tied to others.
TIES = 16
SIGNATURE = 2048
LEAF, FAN = 8, 4
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


class SignatureTree:
    """Sets in the leaves, by size and smallest hash; every node has the OR of its sets' token bitmaps, the range of
    their sizes and the most tokens that one of them has beyond its bits."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0]))
        bits = np.zeros((len(sets), SIGNATURE // 8), np.uint8)
        beyond = np.zeros(len(sets), np.int64)
        for row, i in enumerate(self.order):
            at = np.unique(sets[i] & np.uint64(SIGNATURE - 1)).astype(np.int64)
            np.bitwise_or.at(bits[row], at >> 3, (1 << (at & 7)).astype(np.uint8))
            beyond[row] = len(sets[i]) - len(at)
        size = np.array([len(sets[i]) for i in self.order], np.int64)
        self.levels = [(bits, size, size, beyond)]
        for fan in [LEAF] + [FAN] * 40:
            bits, low, high, beyond = self.levels[-1]
            if len(bits) == 1:
                break
            cut = np.arange(0, len(bits), fan)
            self.levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(beyond, cut)))

    def children(self, level: int, node: int) -> range:
        fan = LEAF if level == 1 else FAN
        return range(node * fan, min(node * fan + fan, len(self.levels[level - 1][0])))


def join_sets(sets: list[np.ndarray], groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span the components of all links between the sets (not empty). ``groups``: only sets of different
    groups are compared, unless the groups are all one.

    Both trees of the traversal are the same one. A pair of nodes is dropped if the size ranges allow no link, if the
    bits in common plus the tokens beyond bits stay below the least overlap of its sizes, or if all its sets are
    already in one component."""
    if len(sets) < 2:
        return []
    tree = SignatureTree(sets)
    order, links = tree.order, []
    root = np.arange(len(sets))  # by place in the tree
    one_group = len(set(groups.tolist())) == 1
    group = groups[np.array(order)]

    def meet(x: int, y: int) -> None:
        if root[x] == root[y] or not (one_group or group[x] != group[y]):
            return
        a, b = sets[order[x]], sets[order[y]]
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return
        if linked(len(a), len(b), int(np.isin(a, b, assume_unique=True).sum()), percent):
            links.append((order[x], order[y]))
            root[root == max(root[x], root[y])] = min(root[x], root[y])

    for x in range(len(sets) - 1):  # copies with small changes mostly stand side by side
        meet(x, x + 1)

    def span(level: int, node: int) -> tuple[int, int]:
        width = 1 if level == 0 else LEAF * FAN ** (level - 1)
        return node * width, min(len(sets), (node + 1) * width)

    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        bits, low, high, beyond = tree.levels[level]
        if level == 0:
            if i != j:
                meet(i, j)
            continue
        (a, b), (c, d) = span(level, i), span(level, j)
        first = root[a]
        if (root[a:b] == first).all() and (root[c:d] == first).all():
            continue
        kids = [(x, y) for x in tree.children(level, i) for y in tree.children(level, j) if x <= y]
        bits, low, high, beyond = tree.levels[level - 1]
        x, y = np.array([k[0] for k in kids]), np.array([k[1] for k in kids])
        fits = (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
        x, y = x[fits], y[fits]
        most = _POP[bits[x] & bits[y]].sum(axis=1, dtype=np.int64) + np.minimum(beyond[x], beyond[y])
        # 100 * both >= percent * (a + b - both), at the least sizes
        fits = (100 + percent) * most >= percent * (low[x] + low[y])
        stack.extend((level - 1, int(p), int(q)) for p, q in zip(x[fits], y[fits], strict=True))
    return links


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, c1, c2 (128 bits that name the set) and tokens, its smallest hashes (as signed numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = shingle_sets(batch.column("text"), width)
            c1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            c2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)) for s in sets], np.uint64).view(np.int64)
            first = [s[:SKETCH].view(np.int64) for s in sets]
            values = pa.array(np.concatenate(first) if first else np.zeros(0, np.int64), pa.int64())
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(c1), pa.array(c2), tokens], names=["doc_id", "n_shingles", "c1", "c2", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, tokens array<long>")


def _coarse_edges(reps: DataFrame, percent: int, hot: int) -> DataFrame:
    """Edges (a, b) whose components hold every two representatives that link, and few others.

    Of tokens that ``hot`` sets or fewer share, the pairs of sets are counted, in groups of that size at most; a pair
    whose sizes allow a link is an edge if it has 15 percent of the smaller number of such tokens in common. At a
    Jaccard index of 0.8, 80 percent are expected; with 0.4 of a set hot, still 66 of the rest, and 4 of 24 are missed
    with a chance of 6e-8. Sets of which more than 0.4 is hot are in a large group of similar sets, or consist of what
    many texts share. They are tied, for each of their first 16 hot tokens and within one or two neighbouring size classes of
    ratio 100 / percent, to the smallest such set: edges as many as tokens, without pairs."""
    tokens = reps.select("doc_id", F.col("n_shingles").alias("n"), F.size("tokens").alias("held"), F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select("token", (F.col("sets") > hot).alias("is_hot"))
    shared = tokens.join(often, "token")
    n_hot = F.sum(F.col("is_hot").cast("int")).over(Window.partitionBy("doc_id"))  # 40 rows at most
    place = F.row_number().over(Window.partitionBy("doc_id", "is_hot").orderBy(F.col("token") < 0, "token"))
    shared = staged(shared.withColumn("n_hot", n_hot).withColumn("place", place).select("doc_id", "n", "token", "is_hot", "place", (F.col("held") - F.col("n_hot")).alias("rest"), (F.col("n_hot") > 0.4 * F.col("held")).alias("dense")), "jaccard-tokens")

    one = F.struct("doc_id", "n", "rest")
    groups = shared.where("NOT is_hot").groupBy("token").agg(F.array_sort(F.collect_list(one)).alias("l")).where("size(l) > 1")
    pairs = F.expr("flatten(transform(sequence(1, size(l) - 1), i -> transform(slice(l, i + 1, size(l) - i), y -> struct(l[i - 1] as x, y))))")
    pairs = groups.select(F.explode(pairs).alias("p")).where(f"100 * least(p.x.n, p.y.n) >= {percent} * greatest(p.x.n, p.y.n)")
    both = pairs.groupBy(F.col("p.x.doc_id").alias("b"), F.col("p.y.doc_id").alias("a")).agg(F.count("*").alias("both"), F.min(F.least("p.x.rest", "p.y.rest")).alias("rest"))
    near = both.where("100 * both >= 15 * rest").select("a", "b")

    rows = shared.where(f"is_hot AND dense AND place <= {TIES}").withColumn("c", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int"))
    rows = rows.select("doc_id", "token", F.explode(F.array("c", F.col("c") + 1)).alias("c"))
    rows = staged(rows, "jaccard-ties")
    least = rows.groupBy("token", "c").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("_last")).where("b <> _last").drop("_last")
    least = staged(least, "jaccard-least")  # so that the join has exchanges alone below it and a hot token can be split
    tied = rows.join(least, ["token", "c"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    return near.unionByName(tied)


def similarity_components(docs: DataFrame, percent: int = 80, width: int = 5, block: int = 1024, hot: int = 32) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links of at least ``percent``.

    1. Sets are sketched and equal sets become one class, for which its smallest doc_id stands.
    2. Representatives that may link meet in coarse components (``_coarse_edges``).
    3. Each component's whole texts go to tasks in blocks of about ``block`` representatives, each pair of blocks in one
       task, where a signature tree joins their whole sets exactly and gives links that span what it found.
    4. Components of these links, and of the classes, are the result.

    A text without words or a null text has no shingles and links with nothing. Rows that repeat a doc_id are one
    document in its component, with a row each; rows without doc_id get n_shingles and their class's component (null
    if no row with doc_id has their set). An empty table gives no rows."""
    sketch = staged(sketches(docs, width), "jaccard-sketches")
    some = sketch.where("n_shingles > 0")
    classes = some.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"))
    classes = staged(classes.where("doc_id IS NOT NULL"), "jaccard-classes")
    reps = some.join(classes.select("c1", "c2", "doc_id"), ["c1", "c2", "doc_id"], "left_semi").dropDuplicates(["c1", "c2"])
    coarse = connected_components(_coarse_edges(staged(reps, "jaccard-reps"), percent, hot))
    coarse = coarse.select(F.col("id").alias("doc_id"), F.col("label").alias("coarse"))
    size = coarse.groupBy("coarse").agg(F.count("*").alias("members"))
    placed = coarse.join(size, "coarse").withColumn("blocks", F.ceil(F.col("members") / float(block)).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = staged(placed.select("doc_id", "coarse", "own", "blocks"), "jaccard-blocks")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(placed.hint("merge"), "doc_id")
    tasks = text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("coarse", F.least("own", "other"), F.greatest("own", "other"))
    tasks = tasks.select(task.alias("task"), "own", "doc_id", "text", (F.col("own") == F.col("other")).alias("alone"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list[int], own: list[int], sets: list[np.ndarray], alone: bool) -> pa.RecordBatch:
            places = {}
            for k, i in enumerate(ids):
                if len(sets[k]):
                    places.setdefault(i, k)
            keep = list(places.values())
            found = join_sets([sets[k] for k in keep], np.array([0 if alone else own[k] for k in keep]), percent)
            return pa.RecordBatch.from_pydict({"a": pa.array([ids[keep[x]] for x, _ in found], pa.int64()), "b": pa.array([ids[keep[y]] for _, y in found], pa.int64())})

        task, alone, ids, own, sets = None, False, [], [], []
        for batch in small_batches(batches):
            found = shingle_sets(batch.column("text"), width)
            for t, o, i, al, s in zip(batch.column("task").to_pylist(), batch.column("own").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("alone").to_pylist(), found, strict=True):
                if t != task:
                    if len(ids) > 1:
                        yield done(ids, own, sets, alone)
                    task, alone, ids, own, sets = t, al, [], [], []
                ids.append(i)
                own.append(o)
                sets.append(s)
        if len(ids) > 1:
            yield done(ids, own, sets, alone)

    links = tasks.repartition(shuffle_parts(docs.sparkSession), "task").sortWithinPartitions("task", "doc_id").mapInArrow(join, "a long, b long")
    parts = connected_components(staged(links, "jaccard-links"))
    named = classes.join(parts, classes["doc_id"] == parts["id"], "left").select("c1", "c2", F.coalesce("label", "doc_id").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "c1", "c2").join(named, ["c1", "c2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The documents that stand for their component: the smallest doc_id of each, and rows without doc_id."""
    own = fresh("id", docs)
    found = similarity_components(docs.select("doc_id", "text"), **options).where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(own), "left_semi").unionByName(docs.where("doc_id IS NULL"))
