"""Removal of byte strings that occur earlier in the corpus: prefix doubling over sampled positions, which Spark ranks by
pairs of ranks at growing offsets until they are unique or past the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix, prefix_hash, shuffle_parts, small_batches, span_hash, staged, text_buffers

NAME = 32  # bytes of the first names
_POS_BITS = 28
HALF = 2 * NAME  # bytes of the second names
ANCHOR, WITNESS, KNOWN, MARK = 0, 1, 2, 3
_ROW = "kind int, h long, f long, ge long, doc_id long, at long"
_SIDE = "h long, e long, doc_id long, at long, right boolean"
_MARK = "doc_id long, at long"


class Sampled:
    """The sampled positions of a batch of texts. In every string of ``length`` bytes one position is chosen by the
    string alone: the least hash of the 32-byte names in it, the last of equals. Equal strings so choose alike, and a
    string occurs twice only where its chosen name does."""

    def __init__(self, column: pa.Array, length: int):
        self.data, self.off = text_buffers(column)
        if len(self.data) >= 1 << _POS_BITS:
            raise ValueError(f"a text of {len(self.data)} bytes; this operator takes texts of less than {1 << _POS_BITS}")
        self.length, n = length, len(self.data)
        self.prefix = prefix_hash(self.data)
        self.chosen = np.zeros(0, np.int64)  # for each window, the byte it chooses
        self.windows = np.zeros(0, np.int64)  # first byte of each window, of all texts
        if n < length:
            self.anchors = np.zeros(0, np.int64)
            return
        at = np.arange(n - NAME + 1, dtype=np.int64)
        self.names = span_hash(self.prefix, at, at + NAME)
        key = (mix(self.names) & ~np.uint64((1 << _POS_BITS) - 1)) | (np.uint64((1 << _POS_BITS) - 1) - at.astype(np.uint64))
        width, have = length - NAME + 1, 1
        while 2 * have <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :]) if width > have else key
        end = np.repeat(self.off[1:], np.diff(self.off))
        p = np.arange(len(key), dtype=np.int64)
        inside = p + length <= end[: len(p)]
        self.windows = p[inside]
        self.chosen = ((1 << _POS_BITS) - 1) - (key[inside] & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
        flag = np.zeros(n, bool)
        flag[self.chosen] = True
        self.anchors = np.flatnonzero(flag)

    def around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor: text index, start and end of all bytes that windows with its name can cover, their name, and 32
        bits each of the names 32 bytes ahead and 32 bytes back (0 where the text ends before)."""
        doc = np.searchsorted(self.off, self.anchors, "right") - 1
        start = np.maximum(self.anchors - (self.length - NAME), self.off[doc])
        end = np.minimum(self.anchors + self.length, self.off[doc + 1])
        name = mix(span_hash(self.prefix, start, end) + ((self.anchors - start) * 1024 + (end - self.anchors)).astype(np.uint64))
        n = len(self.names) - 1
        ahead = np.where(self.anchors + HALF <= self.off[doc + 1], self.names[np.minimum(self.anchors + NAME, n)] >> np.uint64(32) | np.uint64(1), np.uint64(0))
        back = np.where(self.anchors - NAME >= self.off[doc], self.names[np.maximum(self.anchors - NAME, 0)] >> np.uint64(32) | np.uint64(1), np.uint64(0))
        return doc, start, end, name, ahead << np.uint64(32) | back

    def pair_names(self, p: np.ndarray) -> np.ndarray:
        """Names of ``length`` bytes at p, by doubling: pairs of 32-byte names make names of 64, two of those that overlap
        the whole."""
        half = lambda q: mix(mix(self.names[q]) + self.names[q + NAME])
        return mix(mix(half(p)) + half(p + self.length - HALF))


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]).astype(np.int64)
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * big) - group * big
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _out(kind: int, doc: np.ndarray, at: np.ndarray, h: np.ndarray | None = None, f: np.ndarray | None = None, ge: np.ndarray | None = None) -> pa.RecordBatch:
    zero = np.zeros(len(doc), np.int64)
    h = mix(doc.astype(np.uint64)) if h is None else h
    longs = [zero if x is None else x.view(np.int64) for x in (h, f, ge)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *map(pa.array, longs), pa.array(doc), pa.array(at)], names=["kind", "h", "f", "ge", "doc_id", "at"])


def _marks(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and spans (start << 31 | end), united."""
    doc, start, end = _runs(doc, start, end)
    return doc, (start << 31) | end


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """True at the first row of each run of equal keys (sorted)."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Each batch of sorted rows with the row before it and the row behind it (flags say whether there are such), so that a
    row meets its neighbours though no group is ever held."""
    before, now = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches([batch])
        if now is not None:
            yield pa.concat_tables([*([] if before is None else [before]), now, batch.slice(0, 1)]), before is not None, True
            before = now.slice(now.num_rows - 1)
        now = batch
    if now is not None:
        yield pa.concat_tables([*([] if before is None else [before]), now]), before is not None, False


def _shared(head: bool, tail: bool, *keys: np.ndarray) -> np.ndarray:
    """True for the rows proper whose keys equal those of the row before or behind."""
    same = np.ones(len(keys[0]) - 1, bool)
    for k in keys:
        same &= k[1:] == k[:-1]
    out = np.zeros(len(keys[0]), bool)
    out[1:] |= same
    out[:-1] |= same
    return out[int(head) : len(out) - int(tail)]


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, at: spans (start << 31 | end, an array) of each text covered by strings of ``length`` bytes (68 to 128) that
    start earlier as well.

    Prefix doubling over positions that the text itself chooses, one in about 35 bytes, so that equal strings choose
    alike. A rank is the 64-bit name of a string: names of pairs of names.
    1. Spark sorts the sampled positions by the rank of their 32 bytes; those with a rank of their own are dropped.
    2. Spark sorts the rest by pairs of ranks: theirs with that 32 bytes ahead, then theirs with that 32 bytes back.
       Where all 168 bytes around a position that its strings of ``length`` bytes can cover stand earlier, they are
       marked at once. A position with a pair of its own has no repeated string on that side, and is dropped if it has
       none on either.
    3. The strings of ``length`` bytes that chose a position left are ranked by pairs of 64-byte ranks; all but the first
       of equals are marked. The threshold is reached here.
    Equal ranks mean equal strings but for a collision of 64-bit hashes. No group of equal ranks is ever held: rows are
    compared with their neighbours in sorted batches. What a batch of texts shows to be repeated is settled there: known
    repeats skip step 1 but for one witness, so a passage in a third of all documents sends a few rows for each batch."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = batch.column("doc_id").to_numpy()
            s = Sampled(batch.column("text"), length)
            if not len(s.anchors):
                continue
            doc, start, end, f, ge = s.around()
            h = s.names[s.anchors]
            base = s.off[doc]
            order = np.lexsort((s.anchors - base, ids[doc], f, h))
            h, f, ge, doc, base, start, end, at = h[order], f[order], ge[order], doc[order], base[order], start[order], end[order], s.anchors[order]
            new_h, new_f = _first_of(h), _first_of(h, f)
            # Equal doc_id and position (repeated rows) aren't earlier than one another.
            first = np.flatnonzero(new_f)[np.cumsum(new_f) - 1]
            again = ~new_f & ~((ids[doc] == ids[doc[first]]) & (at - base == at[first] - base[first]))
            yield _out(MARK, *_marks(ids[doc][again], (start - base)[again], (end - base)[again]))
            run = np.cumsum(new_h) - 1
            repeated = (np.bincount(run) > 1)[run]
            code = ((at - base) << 16) | ((at - start) << 8) | (end - at)
            for kind, rows in ((ANCHOR, ~repeated), (KNOWN, repeated & ~again)):
                yield _out(kind, ids[doc][rows], code[rows], h[rows], f[rows], ge[rows])
            yield _out(WITNESS, ids[doc][repeated & new_h], code[repeated & new_h], h[repeated & new_h])

    def of_32_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, head, tail in _overlapping(batches):
            kind = t.column("kind").to_numpy()
            shared = _shared(head, tail, kind >= KNOWN, t.column("h").to_numpy())
            own, kind = t.slice(int(head), len(shared)), kind[int(head) : int(head) + len(shared)]
            yield from own.filter(pa.array((kind == ANCHOR) & shared | (kind >= KNOWN))).to_batches()

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked: list[pa.RecordBatch] = []

        def side(h: np.ndarray, e: np.ndarray, doc: np.ndarray, at: np.ndarray, right: np.ndarray, mark: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, (h, e, doc, at, right)), pa.array(np.full(len(h), mark))], names=["h", "e", "doc_id", "at", "right", "mark"])

        def firsts() -> Iterator[pa.RecordBatch]:
            """The first of each surrounding; later ones are marked."""
            first = None  # (h, f, doc_id, at) of the first of the run that the last batch ended in
            for batch in batches:
                if not batch.num_rows:
                    continue
                h, g, e, f, doc, at = (batch.column(c).to_numpy() for c in ("h", "g", "e", "f", "doc_id", "at"))
                new = _first_of(h, f)
                start = np.flatnonzero(new)[np.cumsum(new) - 1]
                f_doc, f_at = doc[start], at[start]
                if first is not None and (h[0], f[0]) == first[:2]:  # the run began before
                    new[0] = False
                    f_doc, f_at = np.where(start == 0, first[2], f_doc), np.where(start == 0, first[3], f_at)
                first = (h[-1], f[-1], f_doc[-1], f_at[-1])
                pos, left, right = at >> 16, (at >> 8) & 255, at & 255
                again = ~new & ~((doc == f_doc) & (pos == f_at >> 16))
                owner, span = _marks(doc[again], (pos - left)[again], (pos + right)[again])
                marked.append(side(mix(owner.astype(np.uint64)).view(np.int64), np.zeros(len(owner), np.int64), owner, span, np.zeros(len(owner), bool), True))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (h[new], g[new], e[new], doc[new], pos[new]))], names=["h", "g", "e", "doc_id", "at"])

        for t, head, tail in _overlapping(firsts()):
            yield from marked
            marked.clear()
            h, g = t.column("h").to_numpy(), t.column("g").to_numpy()
            right = _shared(head, tail, h, g)
            h, g, e, doc, at = (t.column(c).to_numpy()[int(head) : int(head) + len(right)] for c in ("h", "g", "e", "doc_id", "at"))
            yield side(h, e, doc, at, right & (g != 0), False)
        yield from marked

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, head, tail in _overlapping(batches):
            h, e = t.column("h").to_numpy(), t.column("e").to_numpy()
            left = _shared(head, tail, h, e) & (e[int(head) : len(h) - int(tail)] != 0)
            own = t.slice(int(head), len(left))
            right = own.column("right").to_numpy()
            stay = left | right
            code = (own.column("at").to_numpy() << 2) | (left.astype(np.int64) << 1) | right.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.column("doc_id").to_numpy()[stay]), pa.array(code[stay])], names=["doc_id", "at"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = batch.column("doc_id").to_numpy()
            s = Sampled(batch.column("text"), length)
            if not len(s.anchors):
                continue
            lists = batch.column("at")
            code = lists.flatten().to_numpy()
            flag = np.zeros(len(s.data), np.uint8)
            flag[np.repeat(s.off[:-1], lists.value_lengths().fill_null(0).to_numpy()) + (code >> 2)] = code & 3
            side, ahead_of = flag[s.chosen], s.chosen - s.windows
            p = s.windows[((side & 1) > 0) & (ahead_of <= length - HALF) | ((side & 2) > 0) & (ahead_of >= NAME)]
            doc = np.searchsorted(s.off, p, "right") - 1
            at, owner, name = p - s.off[doc], ids[doc], s.pair_names(p)
            order = np.lexsort((at, owner, name))
            name, owner, at = name[order], owner[order], at[order]
            new = _first_of(name)
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = ~new & ~((owner == owner[first]) & (at == at[first]))
            marks = _marks(owner[again], at[again], at[again] + length)
            sent = ~again
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([name[sent].view(np.int64), mix(marks[0].astype(np.uint64)).view(np.int64)])), pa.array(np.concatenate([owner[sent], marks[0]])), pa.array(np.concatenate([at[sent], marks[1]])), pa.array(np.arange(sent.sum() + len(marks[0])) >= sent.sum())], names=["h", "doc_id", "at", "mark"])

    def of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for t, head, tail in _overlapping(batches):
            mark, h, doc, at = (t.column(c).to_numpy() for c in ("mark", "h", "doc_id", "at"))
            b = len(h) - int(tail)
            new = _first_of(h, mark)
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            f_doc, f_at = doc[start], at[start]
            if head and first is not None and (h[0], mark[0]) == first[:2]:
                f_doc, f_at = np.where(start == 0, first[2], f_doc), np.where(start == 0, first[3], f_at)
            first = (h[b - 1], mark[b - 1], f_doc[b - 1], f_at[b - 1])
            own = np.arange(len(h)) >= int(head)
            own[b:] = False
            again = own & ~mark & ~new & ~((doc == f_doc) & (at == f_at))
            found = _marks(doc[again], at[again], at[again] + length)
            old = own & mark
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([doc[old], found[0]])), pa.array(np.concatenate([at[old], found[1]]))], names=["doc_id", "at"])

    n = shuffle_parts(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL AND octet_length(text) >= %d" % length).select(F.col("doc_id").cast("long"), "text")
    known = F.col("kind") >= KNOWN
    key = F.when(known, F.xxhash64("f", "doc_id")).otherwise(F.col("h"))  # what is known needn't meet its like yet
    found = texts.mapInArrow(sample, _ROW).repartition(n, key).sortWithinPartitions(known, "h").mapInArrow(of_32_bytes, _ROW)
    found = staged(found, "repeat-32")
    pairs = found.where(F.col("kind") < MARK).select("h", F.shiftrightunsigned("ge", 32).alias("g"), F.col("ge").bitwiseAND(0xFFFFFFFF).alias("e"), "f", "doc_id", "at")
    pairs = pairs.repartition(n, "h", "g").sortWithinPartitions("h", "g", "f", "doc_id", "at").mapInArrow(ahead, f"{_SIDE}, mark boolean")
    pairs = staged(pairs, "repeat-64")
    left = pairs.where("NOT mark").drop("mark").repartition(n, "h", "e").sortWithinPartitions("h", "e").mapInArrow(back, _MARK)
    some = left.groupBy("doc_id").agg(F.collect_set("at").alias("at"))
    named = texts.join(some, "doc_id").mapInArrow(windows, "h long, doc_id long, at long, mark boolean")
    named = named.repartition(n, "h").sortWithinPartitions("h", "mark", "doc_id", "at").mapInArrow(of_windows, _MARK)
    marks = found.where(F.col("kind") == MARK).select("doc_id", "at").unionByName(pairs.where("mark").select("doc_id", "at")).unionByName(named)
    return marks.groupBy("doc_id").agg(F.collect_set("at").alias("at"))


def cut_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes left of each text, UTF-8), n_bytes, n_removed and n_spans.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller doc_id, or in the same
    document further ahead. Strings are judged on the input and never cross documents. A null text is empty; rows
    that repeat a doc_id are one document, each cut alike; rows without doc_id take no part and stay whole. Cuts may
    fall inside a character, so what is left is bytes. All columns but those named here pass through."""
    keep = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    own, at_ = fresh("doc", docs), fresh("at", docs)
    spans = staged(repeated_spans(docs, length), "repeat-spans").select(F.col("doc_id").alias(own), F.col("at").alias(at_))
    joined = docs.join(spans, docs["doc_id"].cast("long") == F.col(own), "left").select(*[F.col(f"`{c}`") for c in keep], at_)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, off = text_buffers(batch.column("text"))
            kept, removed, runs = [], [], []
            for i, at in enumerate(batch.column(at_).to_pylist()):
                text = data[off[i] : off[i + 1]]
                if not at:
                    kept.append(text.tobytes())
                    removed.append(0)
                    runs.append(0)
                    continue
                code = np.array(at, np.int64)
                _, start, end = _runs(np.zeros(len(code), np.int64), code >> 31, code & ((1 << 31) - 1))
                stay = np.ones(len(text), bool)
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    stay[a:b] = False
                kept.append(text[stay].tobytes())
                removed.append(int((end - start).sum()))
                runs.append(len(start))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(kept, pa.binary()), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=[*keep, "kept", "n_bytes", "n_removed", "n_spans"])

    schema = type(docs.schema)([docs.schema[c] for c in keep]).add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return joined.mapInArrow(cut, schema)
