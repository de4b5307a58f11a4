"""Line deduplication with sharded cuckoo filters in front of exact reference counts; insertions can be undone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mix, shuffle_parts, small_side, staged

SPACES = " \t\n\x0b\f\r"
SLOTS = 4
#: Line keys of a shard, about.
SHARD_KEYS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CuckooFilter:
    """16-bit fingerprints in buckets of four, inserted, looked up and removed a whole array of keys at a time."""

    def __init__(self, buckets: int = 0, table: bytes | None = None):
        self.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy() if table is not None else np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8))))))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys)
        print_ = (h >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        one = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return print_, one, self._other(one, print_)

    def _other(self, place: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return place ^ (mix(print_.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self._places(keys)
        return (self.table[one] == print_[:, None]).any(axis=1) | (self.table[two] == print_[:, None]).any(axis=1)

    def _put(self, place: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """Put each fingerprint into a free slot of its bucket; True where that worked."""
        done = np.zeros(len(place), bool)
        for slot in range(SLOTS):
            free = np.flatnonzero(~done & (self.table[place, slot] == 0))
            _, first = np.unique(place[free], return_index=True)
            take = free[first]
            self.table[place[take], slot] = print_[take]
            done[take] = True
        return done

    def insert(self, keys: np.ndarray) -> bool:
        """False if the table is too full, with a fingerprint lost; the caller then goes back to a copy or a larger one."""
        print_, one, two = self._places(keys)
        left = ~self._put(one, print_)
        left[left] = ~self._put(two[left], print_[left])
        place, print_ = two[left], print_[left]
        for turn in range(500):
            if not len(place):
                return True
            _, first = np.unique(place, return_index=True)  # one eviction a bucket and turn
            kicked, slot = first, (turn + first) % SLOTS
            out = self.table[place[kicked], slot].copy()
            self.table[place[kicked], slot] = print_[kicked]
            rest = np.ones(len(place), bool)
            rest[kicked] = False
            place, print_ = np.concatenate([self._other(place[kicked], out), place[rest]]), np.concatenate([out, print_[rest]])
            stay = ~self._put(place, print_)
            place, print_ = place[stay], print_[stay]
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Remove one fingerprint for each key; the keys must have been inserted."""
        for p, a, b in zip(*self._places(keys), strict=True):
            for place in (a, b):
                slot = np.flatnonzero(self.table[place] == p)
                if len(slot):
                    self.table[place, slot[0]] = 0
                    break


def line_keys(text: Column, min_chars: int) -> Column:
    """The lines of a text as structs of line number and two key hashes; only lines with keys of ``min_chars`` or more."""

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(SPACES))
        return F.when(F.length(k) == F.octet_length(k), F.lower(k)).otherwise(F.translate(k, UPPER, LOWER))

    keys = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("line"), key(line).alias("key")))
    long_ = F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)
    return F.transform(long_, lambda x: F.struct(x["line"], F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2")))


class FilterChain:
    """Filters of growing size that answer as one: keys go into the last, and a new one follows when it is full."""

    def __init__(self, first: CuckooFilter):
        self.filters, self.held = [first], int((first.table > 0).sum())

    def meet(self, keys: np.ndarray) -> np.ndarray:
        """Insert keys; True where a key stands earlier among them or was met before, but for false positives."""
        seen = np.zeros(len(keys), bool)
        for f in self.filters:
            seen |= f.contains(keys)
        _, first = np.unique(keys, return_index=True)
        new = np.zeros(len(keys), bool)
        new[first] = True
        new &= ~seen
        self._insert(keys[new])
        return ~new

    def _insert(self, keys: np.ndarray) -> None:
        while len(keys):
            last = self.filters[-1]
            if self.held + len(keys) <= 0.8 * last.table.size:
                before = last.table.copy()
                if last.insert(keys):
                    self.held += len(keys)
                    return
                last.table = before
            self.filters.append(CuckooFilter(max(2 * len(last.table), len(CuckooFilter.for_keys(2 * len(keys)).table))))
            self.held = 0


class LineIndex:
    """Exact reference counts of line keys, and a cuckoo filter for each shard of the key space.

    ``references`` (h1, h2, doc_id, n) says how often a document holds a key (128 bits of hash); ``filters`` (shard,
    table) hold one fingerprint for each key of the references. An insertion asks the filters first, which meet the
    batch's own keys as they come: a key that no filter has met is new and passes, and only those that may have been met
    are counted exactly, in the batch and in the references. A deletion takes a document's references away and clears
    the fingerprints of keys that no document holds any more. Both return a new index; the tables are Parquet folders."""

    def __init__(self, spark: SparkSession, references: DataFrame | None = None, filters: DataFrame | None = None, shards: int | None = None, min_chars: int = 10):
        self.spark, self.references, self.filters, self.shards, self.min_chars = spark, references, filters, shards, min_chars
        self.before: LineIndex | None = None

    @staticmethod
    def _shard(shards: int) -> Column:
        return F.pmod(F.col("h2"), F.lit(shards)).cast("int")

    def _shards_for(self, keys: int) -> int:
        return self.shards or max(4 * shuffle_parts(self.spark), -(-keys // SHARD_KEYS))

    def _dealt(self, rows: DataFrame, shards: int) -> DataFrame:
        return rows.repartition(max(1, min(shards, shuffle_parts(self.spark))), "shard").sortWithinPartitions("shard", "kind")

    def _maybe_met(self, lines: DataFrame) -> DataFrame:
        """Keys (h1, h2) of ``lines`` that the filters, those of the index and of the batch's earlier keys, may have met:
        all that several documents hold, and few others. Equal keys of an Arrow batch are one row before the shuffle, so a
        line in a third of all documents sends a row for each batch."""
        total = lines.count()
        shards = self._shards_for(total)
        expected = 64 + total * 5 // (4 * shards)

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                doc, h1, h2 = (batch.column(c).to_numpy() for c in ("doc_id", "h1", "h2"))
                order = np.lexsort((h2, h1))
                doc, h1, h2 = doc[order], h1[order], h2[order]
                new = np.ones(len(h1), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                at = np.flatnonzero(new)
                several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.mod(h2[at], shards).astype(np.int32)), pa.array(np.ones(len(at), np.int32)), pa.array(h1[at]), pa.array(h2[at]), pa.array(several)], names=["shard", "kind", "h1", "h2", "several"])

        rows = lines.select("doc_id", "h1", "h2").mapInArrow(combine, "shard int, kind int, h1 long, h2 long, several boolean").withColumn("table", F.lit(None).cast("binary"))
        if self.filters is not None:
            zero = F.lit(0).cast("long")
            rows = rows.unionByName(self.filters.select("shard", F.lit(0).alias("kind"), zero.alias("h1"), zero.alias("h2"), F.lit(False).alias("several"), "table"))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, chain = None, None
            for batch in batches:
                s, kind, tables = batch.column("shard").to_numpy(), batch.column("kind").to_numpy(), batch.column("table")
                h1, h2, several = batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), batch.column("several").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if s[a] != shard:
                        shard, chain = int(s[a]), None
                    if kind[a] == 0:
                        chain, a = FilterChain(CuckooFilter(table=tables[a].as_py())), a + 1
                    chain = chain or FilterChain(CuckooFilter.for_keys(expected))
                    met = chain.meet(h1[a:b].view(np.uint64)) | several[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array(h1[a:b][met]), pa.array(h2[a:b][met])], names=["h1", "h2"])

        met = self._dealt(rows, shards).mapInArrow(ask, "h1 long, h2 long")
        return staged(met.distinct(), "line-met")

    def _changed(self, keys: DataFrame, filters: DataFrame | None, shards: int, removing: bool = False) -> DataFrame:
        """New tables (shard, table) of the shards that ``keys`` (h1, h2; distinct) touch, with a fingerprint more, or less,
        for each; null for a table that grew too full."""
        rows = keys.select(self._shard(shards).alias("shard"), "h1")
        n = staged(rows.groupBy("shard").agg(F.count("*").alias("n")), "line-shards")
        rows = rows.join(small_side(n), "shard").select("shard", F.lit(1).alias("kind"), "h1", "n", F.lit(None).cast("binary").alias("table"))
        if filters is not None:
            zero = F.lit(0).cast("long")
            rows = rows.unionByName(filters.join(small_side(n), "shard").select("shard", F.lit(0).alias("kind"), zero.alias("h1"), "n", "table"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, own, good = None, None, True

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([own.table.tobytes() if good else None], pa.binary())], names=["shard", "table"])

            for batch in batches:
                s, kind, tables = batch.column("shard").to_numpy(), batch.column("kind").to_numpy(), batch.column("table")
                keys, n = batch.column("h1").to_numpy().view(np.uint64), batch.column("n").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if s[a] != shard:
                        if shard is not None:
                            yield done()
                        shard, own, good = int(s[a]), None, True
                    if kind[a] == 0:
                        own, a = CuckooFilter(table=tables[a].as_py()), a + 1
                        good = removing or (own.table > 0).sum() + n[a - 1] <= 0.8 * own.table.size
                    own = own or CuckooFilter.for_keys(2 * int(n[a]))
                    if removing:
                        own.remove(keys[a:b])
                    elif good:
                        good = own.insert(keys[a:b])
            if shard is not None:
                yield done()

        return staged(self._dealt(rows, shards).mapInArrow(run, "shard int, table binary"), "line-filters")

    def insert(self, docs: DataFrame) -> tuple[DataFrame, LineIndex]:
        """(verdicts, index with the documents in it). Verdicts (doc_id, lines): the line numbers to drop, a row for each
        document that loses any: a key that several documents hold, those of the index included, keeps its lines in the
        smallest doc_id alone. Documents of the index stay as they were decided. Rows without doc_id take no part."""
        lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.explode(line_keys(F.col("text"), self.min_chars)).alias("x"))
        lines = staged(lines.select("doc_id", "x.line", "x.h1", "x.h2"), "lines")
        met = small_side(self._maybe_met(lines))
        maybe = staged(lines.join(met, ["h1", "h2"], "left_semi"), "lines-met")
        counts = maybe.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
        if self.references is not None:
            counts = counts.unionByName(self.references.join(met, ["h1", "h2"], "left_semi").select("h1", "h2", "doc_id", "n"))
        owners = counts.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
        owners = small_side(staged(owners.select("h1", "h2", "first"), "line-owners"))
        verdicts = maybe.join(owners, ["h1", "h2"]).where("doc_id <> first").groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))
        new = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
        references = new if self.references is None else self.references.unionByName(new)
        index = LineIndex(self.spark, references, None, self.shards, self.min_chars)
        index.before = self
        return verdicts, index

    def saved(self) -> LineIndex:
        """The index with its tables written, to insert into or delete from later. Shards that hold too many keys by now are
        dealt anew."""
        references = staged(self.references.groupBy("h1", "h2", "doc_id").agg(F.sum("n").alias("n")), "line-references")
        keys = staged(references.select("h1", "h2").distinct(), "line-keys")
        total = keys.count()
        old = self.before if self.before is not None and self.before.references is not None else None
        shards = self._shards_for(total)
        if total > 4 * shards * SHARD_KEYS:
            shards, old = -(-total // SHARD_KEYS), None
        if old is None:
            filters = self._changed(keys, None, shards)
        else:
            new = staged(keys.join(old.references.select("h1", "h2").distinct(), ["h1", "h2"], "left_anti"), "line-new")
            changed = self._changed(new, old.filters, shards)
            filters = changed.unionByName(old.filters.join(small_side(changed.select("shard")), "shard", "left_anti"))
        filters = self._rebuilt(staged(filters, "line-tables"), keys, shards)
        return LineIndex(self.spark, references, filters, shards, self.min_chars)

    def _rebuilt(self, filters: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
        """The filters with those that grew too full built anew from all keys of their shards."""
        full = staged(filters.where("table IS NULL").select("shard"), "line-full")
        if full.isEmpty():
            return filters
        grown = self._changed(keys.withColumn("shard", self._shard(shards)).join(small_side(full), "shard", "left_semi").select("h1", "h2"), None, shards)
        return staged(filters.where("table IS NOT NULL").unionByName(grown), "line-tables")

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index as if the documents (column doc_id) had never been inserted. Call it on a saved index."""
        gone = staged(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "line-gone")
        lost = self.references.join(gone, "doc_id", "left_semi").select("h1", "h2").distinct()
        kept = staged(self.references.join(gone, "doc_id", "left_anti").select("h1", "h2", "doc_id", "n"), "line-references")
        changed = self._changed(staged(lost.join(kept.select("h1", "h2").distinct(), ["h1", "h2"], "left_anti"), "line-lost"), self.filters, self.shards, removing=True)
        filters = changed.unionByName(self.filters.join(small_side(changed.select("shard")), "shard", "left_anti"))
        return LineIndex(self.spark, kept, staged(filters, "line-tables"), self.shards, self.min_chars)


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_chars: int = 10) -> DataFrame:
    """``docs`` with ``text`` less the lines dropped, plus n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased; shorter keys than ``min_chars`` code
    points never count. A null text is one empty line and comes back empty. Rows that repeat a doc_id count as one
    document and lose the same line numbers. Rows without doc_id take no part and stay whole. All other columns pass
    through, whatever their names."""
    index = index or LineIndex(docs.sparkSession, min_chars=min_chars)
    text = F.coalesce(F.col("text"), F.lit(""))
    own, gone, parts = fresh("doc", docs), fresh("lines", docs), fresh("parts", docs)
    verdicts, _ = index.insert(docs.select("doc_id", text.alias("text")))
    verdicts = verdicts.select(F.col("doc_id").alias(own), F.col("lines").alias(gone))
    out = docs.join(verdicts, F.col("doc_id").cast("long") == F.col(own), "left").withColumn(parts, F.split(text, "\n", -1))
    last = F.size(parts) - 1
    keep = F.array_except(F.sequence(F.lit(0), last), F.col(gone))
    cut = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(keep, lambda i: F.element_at(parts, i + 1)), "\n"))
    out = out.withColumn(own, F.size(F.filter(gone, lambda i: i <= last)))  # before the new text, whose name lambdas would take
    n_lines, n_dropped = F.size(parts).cast("long"), F.when(F.col(gone).isNull(), 0).otherwise(F.col(own)).cast("long")
    columns = [cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
