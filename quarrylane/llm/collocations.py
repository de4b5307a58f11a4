"""Phrases whose words stand together more often than alone, by suffix automata of shards and one global count."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix, prefix_hash, runs, shuffle_parts, small_batches, small_side, span_hash, staged, text_buffers, unstage

#: Bytes of text in a shard, about.
SHARD_BYTES = 8 << 20
#: Strings that one range of hashes counts, about.
RANGE_STRINGS = 4_000_000
#: Strings that a task writes out or adds up at once, about, and shares of a range that may be added up by themselves.
STRINGS_AT_ONCE, SHARES = 250_000, 16
_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SHARD = "shard long, langs array<string>, sizes array<long>, lang_of binary, words binary, tokens binary"


class SuffixAutomaton:
    """Generalised suffix automaton of the pieces in ``tokens`` (0 stands between pieces), for strings of ``depth`` words or
    fewer. ``allowed`` may name, by length, the positions where a string of that length may end; strings that hold another
    string of that length aren't built.

    A string of k words is a node of level k, with its number of end positions (``count``), the end of one occurrence
    (``end``) and its suffix link (``link``: the node of level k - 1 without its first word). Nodes come level by level from
    the links, as the tree of links is the tree of reversed prefixes. Strings with the same end positions are one state: a
    node belongs to the state of the longer string that links to it with the same count, and ``left`` names the word
    which then always stands before it. Likewise ``right`` names the word of a node's only transition, if each occurrence
    takes it. 0: none, or none always."""

    def __init__(self, tokens: np.ndarray, depth: int, allowed: dict[int, np.ndarray] | None = None):
        n_tokens = int(tokens.max(initial=0)) + 1
        ends = np.flatnonzero(tokens)
        self.at = [np.zeros(0, np.int32), tokens.astype(np.int32)]  # node of the string that ends at each position, from 1
        self.end, self.count, self.link = [[np.zeros(0, np.int32)] * 2 for _ in range(3)]
        self.left, self.right = [[np.zeros(0, np.int32)] for _ in range(2)]
        self.count[1] = np.bincount(tokens[ends], minlength=n_tokens)[1:].astype(np.int32)
        first = np.zeros(n_tokens, np.int32)
        first[tokens[ends][::-1]] = ends[::-1]
        self.end[1] = first[1:]
        for k in range(2, depth + 1):
            begin = ends - k + 1
            on = begin >= 0
            ends, begin = ends[on], begin[on]
            on = tokens[begin] > 0
            for length, ok in (allowed or {}).items():
                if length <= k:
                    on &= ok[begin + length - 1]
            ends, begin = ends[on], begin[on]
            short = self.at[k - 1]
            keys, one, node, count = np.unique(short[ends].astype(np.int64) * n_tokens + tokens[begin], return_index=True, return_inverse=True, return_counts=True)
            at = np.zeros(len(tokens), np.int32)
            at[ends] = node + 1
            end, count = ends[one].astype(np.int32), count.astype(np.int32)
            link, before = (keys // n_tokens).astype(np.int32), short[end - 1]  # the string without its first word, and without its last
            left, right = np.zeros((2, len(self.count[k - 1]) + 1), np.int32)
            same = count == self.count[k - 1][link - 1]
            left[link[same]] = (keys % n_tokens)[same]
            same = count == self.count[k - 1][before - 1]
            right[before[same]] = tokens[end][same]
            self.left.append(left[1:])
            self.right.append(right[1:])
            for held, new in ((self.at, at), (self.end, end), (self.count, count), (self.link, link)):
                held.append(new)
        for held in (self.left, self.right):
            held.append(np.zeros(len(self.count[depth]), np.int32))

    def words(self, tokens: np.ndarray, k: int, which: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        """Tokens of the strings of level k (of some of them), one array for each word."""
        end = self.end[k][which]
        return [tokens[end - k + 1 + i] for i in range(k)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Bytes, offsets and languages of some texts, ``SHARD_BYTES`` or so; a longer text comes in parts, cut between pieces."""
    for batch in small_batches(batches, limit=SHARD_BYTES, rows=1 << 20):
        data, off = text_buffers(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        at = 0
        while len(langs) == 1 and len(data) - at > SHARD_BYTES:
            cuts = np.flatnonzero(_KIND[data[at : at + SHARD_BYTES]] == 2)
            if len(cuts):
                to = at + int(cuts[-1]) + 1
            else:
                later = np.flatnonzero(_KIND[data[at + SHARD_BYTES :]] == 2)
                to = at + SHARD_BYTES + int(later[0]) + 1 if len(later) else len(data)
            yield data[at:to], np.array([0, to - at]), langs
            at = to
        yield data[at:], off - at if len(langs) == 1 else off, langs


def _shard(data: np.ndarray, off: np.ndarray, langs: list[str]) -> tuple[list[str], list[int], np.ndarray, bytes, np.ndarray] | None:
    """Languages, their word counts, the language and the text of each token, and the tokens: words numbered from 1 by
    language, 0 between pieces. None for texts without a word."""
    off = np.maximum(off, 0)
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    begin, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = inside[1:-1][edge]
    last[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    if not len(starts):
        return None
    doc = np.searchsorted(off, starts, "right") - 1
    piece = np.cumsum(kind == 2)[starts]
    word_off = np.concatenate([[0], np.cumsum(ends - starts)])
    all_words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(word_off.astype(np.int64)), pa.py_buffer(_LOWER[data[inside[1:-1]]])])
    coded = all_words.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    named = pa.array(langs, pa.string()).dictionary_encode()
    names, lang_of_doc = named.dictionary.to_pylist(), named.indices.to_numpy()
    both, tokens = np.unique(lang_of_doc[doc].astype(np.int64) * len(coded.dictionary) + ids, return_inverse=True)
    lang_of = (both // len(coded.dictionary)).astype(np.int32)
    words = coded.dictionary.take(pa.array(both % len(coded.dictionary)))
    sizes = np.bincount(lang_of[tokens], minlength=len(names)).tolist()
    new = np.zeros(len(starts), np.int64)
    new[1:] = (np.diff(piece) > 0) | (np.diff(doc) > 0)
    out = np.zeros(len(starts) + int(new.sum()), np.int32)
    out[np.arange(len(starts)) + np.cumsum(new)] = tokens + 1
    return names, sizes, lang_of, b" ".join(words.to_pylist()), out


def shards(docs: DataFrame) -> DataFrame:
    """One row for each shard (about 8 MB of text) with its tokens; staged, as shards are read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for texts in _texts(batches):
            made = _shard(*texts)
            if made is not None:
                langs, sizes, lang_of, words, tokens = made
                columns = [[number], [langs], [sizes], [lang_of.tobytes()], [words], [_planes(tokens)]]
                kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "langs", "sizes", "lang_of", "words", "tokens"])
                number += 1

    return staged(docs.mapInArrow(run, SHARD), "phrase-shards")


def _planes(x: np.ndarray) -> bytes:
    """The values' first bytes, then all second ones and so on: high bytes, mostly equal, compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


class _Dealt:
    """Hashed strings of a shard with their counts, dealt to ``n_ranges`` ranges of hashes: ``order`` sorts them, range r has
    those from ``cuts[r]`` to ``cuts[r + 1]``, and ``place`` is a hash's place within its range, in 32 bits."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_ranges: int):
        self.order = np.argsort(hashes)
        h, n, low = hashes[self.order], np.uint64(n_ranges), np.uint64(0xFFFFFFFF)
        scaled = (h >> np.uint64(32)) * n + (((h & low) * n) >> np.uint64(32))
        self.cuts = np.searchsorted((scaled >> np.uint64(32)).astype(np.int64), np.arange(n_ranges + 1))
        self.place, self.counts = (scaled & low).astype(np.uint32), counts[self.order]

    def report(self, shard: int, cap: int) -> pa.RecordBatch:
        some = np.flatnonzero(np.diff(self.cuts))
        counts = np.minimum(self.counts, cap).astype(np.uint16)
        spans = [(self.cuts[r], self.cuts[r + 1]) for r in some]
        steps = [_planes(np.diff(self.place[a:b], prepend=np.uint32(0))) for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([shard] * len(some), pa.int64()), pa.array(steps, pa.binary()), pa.array([_planes(counts[a:b]) for a, b in spans], pa.binary())], names=["range", "shard", "places", "counts"])

    def often(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Which strings may occur often, from the answers of the ranges."""
        out = np.zeros(len(self.order), bool)
        for r, bits in answers:
            a, b = int(self.cuts[r]), int(self.cuts[r + 1])
            out[self.order[a:b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return out


def _joined_hash(words: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    out = np.full(len(words[0]), np.uint64(len(words)))
    for w in words:
        out = mix(out * np.uint64(0x100000001B3) + hashes[w - 1])
    return out


class _Shard:
    """A shard in a task. ``hashes`` are those of its words with their language."""

    def __init__(self, row: dict):
        self.shard, self.langs = row["shard"], row["langs"]
        self.tokens, self.lang_of = _unplaned(row["tokens"], np.int32), np.frombuffer(row["lang_of"], np.int32)
        self.vocabulary = row["words"].split(b" ") if len(self.lang_of) else []
        data = np.frombuffer(row["words"], np.uint8)
        size = np.fromiter(map(len, self.vocabulary), np.int64, len(self.vocabulary))
        ends = np.cumsum(size + 1) - 1
        self.word_hash = span_hash(prefix_hash(data), ends - size, ends)
        seed = np.array([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest()) for name in self.langs], np.uint64)
        self.hashes = mix(self.word_hash + seed[self.lang_of])

    def pairs(self, n_ranges: int) -> tuple[_Dealt, SuffixAutomaton]:
        """Words, then pairs of words."""
        own = SuffixAutomaton(self.tokens, 2)
        return _Dealt(np.concatenate([self.hashes, _joined_hash(own.words(self.tokens, 2), self.hashes)]), np.concatenate(own.count[1:]), n_ranges), own

    def triples(self, n_ranges: int) -> tuple[_Dealt, SuffixAutomaton]:
        own = SuffixAutomaton(self.tokens, 3)
        return _Dealt(_joined_hash(own.words(self.tokens, 3), self.hashes), own.count[3], n_ranges), own


def _linked_runs(tokens: np.ndarray, pair: np.ndarray, often: np.ndarray, often_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that may occur often, and the runs of them whose pairs may, numbered by these words from 1, 0 between runs.
    ``pair``: the pair that ends at each position, from 1. A pair may count as frequent since others share its place; it is
    none if a word of it isn't, which has no number here."""
    words = np.flatnonzero(often)
    held = np.append(often, False)[tokens - 1]
    linked = (pair > 0) & np.append(often_pairs, False)[pair - 1] & held & np.append(False, held[:-1])
    kept = np.flatnonzero(linked | np.append(linked[1:], False))
    first = ~linked[kept]
    chains = np.zeros(len(kept) + int(first.sum()), np.int32)
    chains[np.arange(len(kept)) + np.cumsum(first)] = (np.searchsorted(words, tokens[kept] - 1) + 1).astype(np.int32)
    return words, chains


_MERGE = {"words": "max", "a": "sum", "shards": "sum", "left_n": "sum", "left_min": "min", "left_max": "max", "right_n": "sum", "right_min": "min", "right_max": "max"}


def _counted(shard: _Shard, automaton: SuffixAutomaton, totals: np.ndarray, k: int, which: np.ndarray) -> pa.Table:
    """A row for each of some strings of k words: its count in the shard, and for either side the word that always stands
    there, null if there is none."""
    vocabulary, langs = pa.array(shard.vocabulary, pa.binary()).cast(pa.string()), pa.array(shard.langs, pa.string())
    tokens = [which + 1] if k == 1 else automaton.words(shard.tokens, k, which)
    phrase = pc.binary_join_element_wise(*[vocabulary.take(pa.array(w - 1)) for w in tokens], " ") if len(which) else vocabulary.slice(0, 0)
    neighbour = np.append(shard.word_hash, np.uint64(0)).view(np.int64)
    counts = (totals if k == 1 else automaton.count[k])[which].astype(np.int64)
    columns = [langs.take(pa.array(shard.lang_of[tokens[0] - 1])), phrase, pa.array(np.full(len(which), k, np.int32)), pa.array(counts)]
    for side in (automaton.left[k], automaton.right[k]):
        side = np.zeros(len(which), np.int32) if k == 1 else side[which]
        columns.append(pa.array(neighbour[side - 1], pa.int64(), mask=side == 0))
    return pa.table(columns, names=["lang", "phrase", "words", "a", "left", "right"])


def _dealt_strings(shard: _Shard, automaton: SuffixAutomaton, totals: np.ndarray, max_words: int, n_ranges: int) -> Iterator[pa.RecordBatch]:
    """All strings of a shard, packed by range in the order of their hashes, with the cuts of a range's ``SHARES``; strings
    become rows for some ranges at a time, as those of a large corpus, little pruned, are several for each of its words."""
    single = np.arange(1, len(shard.vocabulary) + 1)
    hashes = [_joined_hash([single] if k == 1 else automaton.words(shard.tokens, k), shard.hashes) for k in range(1, max_words + 1)]
    begin = np.cumsum([0, *map(len, hashes)])
    dealt = _Dealt(np.concatenate(hashes), np.zeros(begin[-1], np.uint8), n_ranges)
    del hashes
    lo = 0
    while lo < n_ranges:
        hi = max(lo + 1, int(np.searchsorted(dealt.cuts, dealt.cuts[lo] + STRINGS_AT_ONCE, "right")) - 1)
        own = dealt.order[dealt.cuts[lo] : dealt.cuts[hi]]
        level = np.searchsorted(begin, own, "right")
        at = [np.flatnonzero(level == k) for k in range(1, max_words + 1)]
        strings = pa.concat_tables([_counted(shard, automaton, totals, k, own[x] - begin[k - 1]) for k, x in enumerate(at, 1)])
        strings = strings.take(pa.array(np.argsort(np.concatenate(at))))
        cuts = dealt.cuts[lo : hi + 1] - dealt.cuts[lo]
        some = np.flatnonzero(np.diff(cuts))
        shares = [np.searchsorted(dealt.place[dealt.cuts[lo + r] : dealt.cuts[lo + r + 1]], np.arange(SHARES + 1, dtype=np.uint64) * ((1 << 32) // SHARES)).astype(np.int32) for r in some]
        packed = [_packed(strings.slice(cuts[r], cuts[r + 1] - cuts[r])) for r in some]
        yield pa.RecordBatch.from_arrays([pa.array(some + lo, pa.int32()), pa.array([x.tobytes() for x in shares], pa.binary()), pa.array(packed, pa.binary())], names=["range", "shares", "strings"])
        lo = hi


def _packed(strings: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, strings.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(strings.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes, a: int, b: int) -> pa.Table:
    """Some of the packed strings of a shard, as ``_merged`` adds them up."""
    own = pa.ipc.open_stream(raw).read_all()
    if b - a < own.num_rows:
        own = own.take(pa.array(np.arange(a, b)))  # a slice would hold the rest, too
    columns = [own.column("words"), own.column("a"), pa.array(np.ones(b - a, np.int64))]
    for side in (own.column("left"), own.column("right")):
        columns += [side.is_valid().cast(pa.int64()), side, side]
    return pa.table([own.column("lang"), own.column("phrase"), *columns], names=["lang", "phrase", *_MERGE])


def _merged(tables: list[pa.Table]) -> pa.Table:
    """One row for each string: counts added up, the neighbours' least and largest."""
    grouped = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate(list(_MERGE.items()))
    return grouped.select(["lang", "phrase", *[f"{c}_{f}" for c, f in _MERGE.items()]]).rename_columns(["lang", "phrase", *_MERGE])


def _with_answers(source: DataFrame, strings: str, n_ranges: int, cap: int) -> DataFrame:
    """The shards of ``source``, each followed by what the ranges answer on its ``strings`` (pairs or triples): one bit for
    each string, whether its counts in all shards add up to ``cap`` or more. Rows of a shard stand together, it first."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Shard(batch.slice(i, 1).to_pylist()[0])
                yield getattr(shard, strings)(n_ranges)[0].report(shard.shard, cap)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in runs(batches, "range"):
            ids: list[int] = []
            places: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            for batch in own:
                ids += batch.column("shard").to_pylist()
                places += [np.cumsum(_unplaned(p, np.uint32), dtype=np.uint32) for p in batch.column("places").to_pylist()]
                counts += [_unplaned(c, np.uint16) for c in batch.column("counts").to_pylist()]
            parts = [np.zeros(len(p), bool) for p in places]
            cuts = [np.searchsorted(p, np.arange(SHARES + 1, dtype=np.uint64) * ((1 << 32) // SHARES)) for p in places]  # places ascend
            for i in range(SHARES):
                spans = [slice(c[i], c[i + 1]) for c in cuts]
                _, place = np.unique(np.concatenate([p[x] for p, x in zip(places, spans, strict=True)]), return_inverse=True)
                often = np.bincount(place, weights=np.concatenate([c[x] for c, x in zip(counts, spans, strict=True)]))[place] >= cap
                for part, x, own_often in zip(parts, spans, np.split(often, np.cumsum([x.stop - x.start for x in spans])[:-1]), strict=True):
                    part[x] = own_often
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([number] * len(ids), pa.int32()), pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())], names=["shard", "range", "often"])

    reports = source.mapInArrow(report, "range int, shard long, places binary, counts binary")
    answers = reports.repartition(n_ranges, "range").sortWithinPartitions("range").mapInArrow(judge, "shard long, range int, often binary")
    rows = source.withColumns({"kind": F.lit(0), "range": F.lit(None).cast("int"), "often": F.lit(None).cast("binary")})
    blank = {f: F.lit(None).cast(t) for f, t in source.dtypes if f != "shard"}
    rows = rows.unionByName(answers.withColumn("kind", F.lit(1)).withColumns(blank))
    n_parts = max(shuffle_parts(source.sparkSession), source.count() // 4)
    return rows.repartition(n_parts, "shard").sortWithinPartitions("shard", "kind", "range")


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[int, bytes]]]]:
    for _, own in runs(batches, "shard"):
        row, answers = {}, []
        for batch in own:
            if not row:
                row, batch = batch.slice(0, 1).to_pylist()[0], batch.slice(1)
            answers += zip(batch.column("range").to_pylist(), batch.column("often").to_pylist(), strict=True)
        yield row, answers


def _strings(source: DataFrame, n_ranges: int, min_count: int, max_words: int) -> DataFrame:
    """lang, phrase, words, a (occurrences) and inside (whether a longer string occurs as often) of every string of up to
    ``max_words`` words with ``min_count`` occurrences or more."""
    cap = min(min_count, 65_535)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards of the words that may occur often, and of the runs of them whose pairs may."""
        for row, answers in _answered(batches):
            shard = _Shard(row)
            dealt, automaton = shard.pairs(n_ranges)
            often = dealt.often(answers)
            words, chains = _linked_runs(shard.tokens, automaton.at[2], often[: len(shard.vocabulary)], often[len(shard.vocabulary) :])
            counts = automaton.count[1][words].astype(np.int64)
            columns = [[shard.shard], [shard.langs], [shard.lang_of[words].tobytes()], [b" ".join([shard.vocabulary[w] for w in words])], [_planes(chains)], [counts.tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "langs", "lang_of", "words", "tokens", "totals"])

    def enumerate_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in _answered(batches):
            shard = _Shard(row)
            dealt, automaton = shard.triples(n_ranges)
            ok = np.append(dealt.often(answers), False)[automaton.at[3] - 1]
            automaton = SuffixAutomaton(shard.tokens, max_words, {3: ok})
            yield from _dealt_strings(shard, automaton, np.frombuffer(row["totals"], np.int64), max_words, n_ranges)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact counts of a range's strings, by shares of the range so large that few strings are held at once."""
        for _, own in runs(batches, "range"):
            packed: list[bytes] = []
            shares: list[np.ndarray] = []
            for batch in own:
                packed += batch.column("strings").to_pylist()
                shares += [np.frombuffer(x, np.int32) for x in batch.column("shares").to_pylist()]
            step = SHARES
            while step > 1 and sum(int(x[-1]) for x in shares) * step > 2 * STRINGS_AT_ONCE * SHARES:
                step //= 2
            for i in range(0, SHARES, step):
                total, more, rows = None, [], 0
                for raw, x in zip(packed, shares, strict=True):
                    if x[i] < x[i + step]:
                        more.append(_unpacked(raw, int(x[i]), int(x[i + step])))
                        rows += more[-1].num_rows
                    if rows > 2 * STRINGS_AT_ONCE:
                        total, more, rows = _merged([*([] if total is None else [total]), *more]), [], 0
                if total is None and not more:
                    continue
                total = _merged([*([] if total is None else [total]), *more])
                always = [pc.and_kleene(pc.equal(total.column(f"{side}_n"), total.column("shards")), pc.equal(total.column(f"{side}_min"), total.column(f"{side}_max"))) for side in ("left", "right")]
                total = total.select(["lang", "phrase", "words", "a"]).append_column("inside", pc.fill_null(pc.or_kleene(*always), False))
                yield from total.filter(pc.greater_equal(total.column("a"), min_count)).combine_chunks().to_batches()

    runs_ = staged(_with_answers(source.drop("sizes"), "pairs", n_ranges, cap).mapInArrow(cut, "shard long, langs array<string>, lang_of binary, words binary, tokens binary, totals binary"), "phrase-runs")
    unstage(source)
    found = _with_answers(runs_, "triples", n_ranges, cap).mapInArrow(enumerate_strings, "range int, shares binary, strings binary")
    found = found.repartition(n_ranges, "range").sortWithinPartitions("range").mapInArrow(add_up, "lang string, phrase string, words int, a long, inside boolean")
    found = staged(found, "phrase-strings")
    unstage(runs_)
    return found


def mine_phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, limit: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``limit`` phrases of 2 to ``max_words`` words by score.

    A-Z is lower-cased, texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs.
    Phrases with a >= ``min_count`` occurrences (overlaps included) are candidates, but for those inside a longer candidate
    that occurs as often. Of the cuts of a phrase into two parts with l and r occurrences the one with the lowest score
    floor(1000 * a * n / (l * r)) counts (n: words of the language), ties to the earliest.

    Each shard reports the hashes and counts of its words and pairs of words; ranges of hashes add them up and answer which
    may reach ``min_count`` (a string can't without its parts, and equal hashes only keep more). So do three words of what
    is left. Then the shard's automaton enumerates the strings whose parts all may, and one grouped sum has their exact counts. A phrase lies in a longer one as frequent
    just if one word always stands before it, or after it: in every shard its state reaches further left by the same word
    (it is a suffix link's target), or its only transition is the same.

    Null text: no words. Null language: ``und``. Rows that repeat count each. No row for languages without candidates;
    an empty table gives an empty result. Memory of a task follows the shard, which is longer than 8 MB only where a
    piece is. Columns other than text and language aren't read."""
    spark = docs.sparkSession
    own = shards(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")))
    sizes = own.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n"))
    sizes = staged(sizes, "phrase-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    strings = _strings(own, max(shuffle_parts(spark), total // RANGE_STRINGS), min_count, max_words)

    w = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(w, start, n), " ")
    cuts = strings.where("words >= 2 AND NOT inside").select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", part(F.lit(1), F.col("cut"))).withColumn("rest", part(F.col("cut") + 1, F.col("words") - F.col("cut")))
    counts = lambda name, n: strings.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = cuts.join(counts("first", "l"), ["lang", "first"]).join(counts("rest", "r"), ["lang", "rest"]).join(small_side(sizes), "lang")
    score = F.expr("CAST(1000 * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS LONG)")
    least = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    out = least.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))
    parts = shuffle_parts(spark)
    for salts in sorted({parts, math.isqrt(parts), 1}, reverse=True):  # first those of a share of the phrases, then fewer and larger shares
        best = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
