"""Phrase mining, whitening and pivot search against plain Python and numpy."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.llm import collocations
from quarrylane.llm.collocations import SuffixAutomaton, mine_phrases
from quarrylane.llm.pivot_search import PivotIndex, farthest_first
from quarrylane.llm.whitening import Whitening

# ---- phrases


def phrases_by_hand(rows, least, longest=5, limit=2000):
    lower = {c: c + 32 for c in range(65, 91)}
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= least and len(p) > 2}
    out = {}
    for (lang, *w), a in often.items():
        longer = (p for p, c in often.items() if p[0] == lang and len(p) > len(w) + 1 and c >= a)
        if any(list(p[1:][i : i + len(w)]) == w for p in longer for i in range(len(p) - len(w))):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:limit], 1)}


def mined(df, **options):
    return {tuple(r) for r in mine_phrases(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def corpus():
    rng = random.Random(4)
    words = ["New", "york", "CITY", "of", "the", "été", "ΣΑΣ", "a", "b", "x y", "z "]
    rows = []
    for i in range(240):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", "", None, "und"]), text))
    return [*rows, *[("en", "always stands here together")] * 9, ("en", None), ("fr", ""), (None, " \t.,;"), ("de", "a " * 3000), ("en", "one-long-word" * 2000)]


@pytest.mark.parametrize("shard_bytes", [300, 8 << 20])
def test_phrases(spark, monkeypatch, shard_bytes):
    rows = corpus()
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "a long, lang string, text string, phrase string").repartition(3)
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(collocations, "RANGE_STRINGS", 500)
    assert mined(df, min_count=5) == phrases_by_hand(rows, 5)
    assert mined(df, min_count=2, max_words=3, limit=7) == phrases_by_hand(rows, 2, 3, 7)


def test_strings_are_listed_and_added_up_a_share_at_a_time(spark, monkeypatch):
    """What a task holds doesn't follow how many strings of a shard or of a range the rest of the corpus makes frequent."""
    rows = corpus()
    monkeypatch.setattr(collocations, "STRINGS_AT_ONCE", 60)
    data = " . ".join(t or "" for _, t in rows).encode()
    langs, _, lang_of, words, tokens = collocations._shard(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ["en"])
    shard = collocations._Shard({"shard": 1, "langs": langs, "lang_of": lang_of.tobytes(), "words": words, "tokens": collocations._planes(tokens)})
    automaton = SuffixAutomaton(shard.tokens, 4)
    batches = list(collocations._dealt_strings(shard, automaton, automaton.count[1], 4, 40))
    held = [sum(int(np.frombuffer(x, np.int32)[-1]) for x in b.column("shares").to_pylist()) for b in batches]
    assert len(batches) > 10 and sum(held) == sum(map(len, automaton.count)) and all(h <= 60 or b.num_rows == 1 for h, b in zip(held, batches, strict=True))
    assert [r for b in batches for r in b.column("range").to_pylist()] == list(range(40))
    parts = collocations._unpacked(batches[0].column("strings")[0].as_py(), 1, 3)
    assert parts.num_rows == 2 and parts.column("shards").to_pylist() == [1, 1]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert mined(df, min_count=5) == phrases_by_hand(rows, 5)  # in several shares, as a range has more than 120 strings


def test_pairs_of_a_rare_word_are_none():
    """Other strings at its place may make a pair look frequent; its rare word then was read as the next frequent one."""
    tokens = np.array([1, 2, 3, 0, 4, 3, 1], np.int32)
    pair = SuffixAutomaton(tokens, 2).at[2]
    often = np.array([True, False, True, True])
    words, chains = collocations._linked_runs(tokens, pair, often, np.ones(pair.max(), bool))
    assert words.tolist() == [0, 2, 3] and chains.tolist() == [0, 3, 2, 1]


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert mined(df) == mined(df.where("false")) == set()


def test_long_texts_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "SHARD_BYTES", 50)
    text = "one two three. " * 40 + "no-end " * 30 + "; tail"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([text, "short"])], names=["lang", "text"])
    parts = list(collocations._texts(iter([batch])))
    assert b"".join(bytes(d) for d, _, langs in parts if langs == ["en"]) == text.encode()
    assert len(parts) > 10 and all(bytes(d)[-1:] in b".;" for d, _, langs in parts[:-2])


def test_suffix_automaton():
    tokens = np.array([1, 2, 3, 1, 2, 4, 0, 5, 1, 2, 0, 6, 7, 0, 6, 7], np.int32)
    own = SuffixAutomaton(tokens, 3)
    strings = {tuple(int(w[i]) for w in own.words(tokens, k)): (k, i) for k in (1, 2, 3) for i in range(len(own.count[k]))}
    pieces = [[1, 2, 3, 1, 2, 4], [5, 1, 2], [6, 7], [6, 7]]
    hand = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
    assert {s: int(own.count[k][i]) for s, (k, i) in strings.items()} == hand
    for s, (k, i) in strings.items():
        if k > 1:
            assert strings[s[1:]] == (k - 1, int(own.link[k][i]) - 1)
    assert [int(own.right[1][strings[(w,)][1]]) for w in (1, 2, 3, 6)] == [2, 0, 1, 7]
    assert [int(own.left[1][strings[(w,)][1]]) for w in (1, 2, 4, 7)] == [0, 1, 2, 6]


# ---- vectors

SCHEMA = "vec_id long, embedding array<float>, n string, x int"


def vectors(n, dim, seed, clusters=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(i, [float(c) for c in (centres[i % clusters] + rng.normal(size=dim) * (0.1 + np.arange(dim) / dim)).astype("f4")], "n", i) for i in range(n)]


BAD = [(9001, None, "n", 1), (9050, [], "n", 1), (9100, [1.0, None], "n", 1), (9150, [float("nan")] * 6, None, 1), (9200, [float("inf")] + [1.0] * 5, "n", None), (9250, [1.0, 2.0], "n", 1)]


def whitened_by_hand(rows):
    x = np.floor(1024 * np.array([r[1] for r in rows], "f4").astype("f8")).astype("i8") + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    kept = min(8, int((e > 1e-11 * e[-1]).sum()))
    e, u, trace = e[::-1][:kept], u[:, ::-1][:, :kept], e.sum()
    return [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, s, strict=True)) for r in x], (c @ u) / np.sqrt(e), e / trace


@pytest.mark.parametrize(("n", "dim"), [(400, 6), (300, 40), (3, 6)])
def test_whitening(spark, n, dim):
    rows = vectors(n, dim, n)
    rows += [r for r in rows[:1] for _ in range(3)]
    bad = [b for b in BAD if b[1] is None or len(b[1]) != dim or dim == 6]
    own = Whitening.fit(spark.createDataFrame(rows + bad, SCHEMA).repartition(5))
    got = own.transform().collect()
    deviation, white, explained = whitened_by_hand(rows)
    assert sorted((r.vec_id, int(r.deviation)) for r in got) == sorted(zip([r[0] for r in rows], deviation, strict=True))
    assert own.n == len(rows) and np.allclose(own.explained, explained, rtol=1e-9) and own.identity_error < 1e-9
    mine = {r.vec_id: np.array(r.whitened) for r in got}
    sign = np.sign(sum(mine[r[0]] * w for r, w in zip(rows, white, strict=True)))
    assert max(np.abs(mine[r[0]] * sign - w).max() for r, w in zip(rows, white, strict=True)) < 1e-8


def test_whitening_of_little(spark):
    for rows in ([], BAD[:5], [(1, [1.0, 2.0], "n", 1)], [(i, [1.0, 2.0], "n", 1) for i in range(5)]):
        own = Whitening.fit(spark.createDataFrame(rows, SCHEMA))
        assert own.vectors.shape[1] == 0 and all(list(r.whitened) == [] and r.deviation == 0 for r in own.transform().collect())


def test_low_rank_whitening_keeps_the_components_there_are(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), float(b), float(a), 0.0], "n", 1) for i, (a, b) in enumerate(rng.integers(-4, 4, (60, 2)))]
    own = Whitening.fit(spark.createDataFrame(rows, SCHEMA))
    assert own.vectors.shape == (4, 2) and own.identity_error < 1e-9


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).normal(size=3).astype("f4") * 2e7], "n", 1) for i in range(90)]
    got = {r.vec_id: int(r.deviation) for r in Whitening.fit(spark.createDataFrame(rows, SCHEMA)).transform().collect()}
    assert [got[i] for i in range(90)] == whitened_by_hand(rows)[0] and max(got.values()) > 1 << 63


def found_by_hand(rows, every, k):
    held = {(r[0], tuple(np.floor(256 * np.array(r[1], "f4").astype("f8")).astype("i8").tolist())) for r in rows if r[0] is not None}
    out = []
    for i, q in held:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in held if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "block"), [(700, 6, 32), (400, 24, 64), (5, 6, 2048)])
def test_pivot_search(spark, n, dim, block):
    rows = vectors(n, dim, n, 9)
    rows += [(20_000 + i, rows[4][1], "n", 1) for i in range(80)] + [rows[3]] * 3 + [(30_000, [0.0] * dim, "n", 1), (None, rows[1][1], "n", 1)]
    rows += [(50, rows[2][1], "n", 1)] if n > 50 else []
    bad = [b for b in BAD if b[1] is None or len(b[1]) != dim or dim == 6]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    index = PivotIndex.build(df, pivots=12, sample_rows=100, block_rows=block)
    got = index.search(df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")), page=4)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == found_by_hand(rows, 50, 5)


def test_pivot_search_of_large_numbers(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).normal(size=4).astype("f4") * 1e5], "n", 1) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = PivotIndex.build(df, block_rows=16).search(df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")))
    assert sorted(tuple(r) for r in got.collect()) == found_by_hand(rows, 50, 5)


def test_pivot_search_of_nothing(spark):
    for rows in ([], BAD[:5], [(50, [1.0, 2.0], "n", 1)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert PivotIndex.build(df).search(df.select(F.col("vec_id").alias("query_id"))).collect() == []


def test_rows_are_skipped_by_their_bounds(spark):
    """In a plane with many clusters most blocks are never sent a query."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in (rng.integers(-9, 9, 2) * 50 + rng.normal(size=2)).astype("f4")], "n", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = PivotIndex.build(df, block_rows=32)
    got = index.search(df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")))
    assert sorted(tuple(r) for r in got.collect()) == found_by_hand(rows, 100, 5)
    assert len(farthest_first(np.ones((5, 2)), 9)) == 2
