"""Every operator against a brute-force version on a small table with hard rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylane.llm import jaccard_join, language_id, line_dedup, neighbours, packing, quality, secret_scan, source_mix, suffix_dedup, token_files
from quarrylane.llm.tokens import CachedEncoder

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text, end):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_mix(docs, rows, brute, empty):
    got = {r["doc_id"]: r for r in source_mix.mix_sources(docs).collect()}
    assert len(got) == len(rows)
    size = {r[0]: len(brute.words(r[1])) for r in rows}
    by = Counter()
    for r in rows:
        by[r[3]] += size[r[0]]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target, free = {}, set(by)
    while True:
        level = (sum(by.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * by[s]}
        if not over:
            break
        target |= {s: 3 * by[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    for r in rows:
        g = got[r[0]]
        assert (g["size"], g["source_size"]) == (size[r[0]], by[r[3]]) and abs(g["target"] - target[r[3]]) < 1e-6
        assert 0 <= g["taken"] <= 3 * g["size"] and g["taken"] == g["copies"] * g["size"]
    assert got == {r["doc_id"]: r for r in source_mix.mix_sources(docs).collect()}
    assert source_mix.mix_sources(empty).count() == 0
    assert source_mix.mixed_documents(docs).count() == sum(g["copies"] for g in got.values())


def test_jaccard(docs, rows, brute, empty):
    sets = {}
    for i, text, *_ in rows:
        w = brute.words(brute.lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    for hot in (32, 2):  # 2: nearly all tokens are hot
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_components(docs, hot=hot, block=3).collect()}
        assert got == {i: (len(s), label[i]) for i, s in sets.items()}
    assert jaccard_join.similarity_components(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_signature_tree(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(20, 60)), replace=False), rng.integers(1, 1 << 62, int(rng.integers(0, 8)), dtype=np.uint64)])) for _ in range(40)]

    def parts(links):
        root = list(range(40))
        for _ in range(40):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    every = [(a, b) for a in range(40) for b in range(a) if jaccard_join.linked(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])), 80)]
    assert parts(jaccard_join.join_sets(sets, np.zeros(40), 80)) == parts(every)


def test_language(spark, docs, empty):
    texts = [("de", "der schnelle braune fuchs springt über den faulen hund und"), ("en", "the quick brown fox jumps over the lazy dog and then"), ("fr", "le renard brun et rapide saute par dessus le chien")]
    labelled = spark.createDataFrame([(3 * k + i, f"{t} {k}", lang) for k in range(40) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    got = language_id.identify(labelled, model).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    und = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert [und[i] for i in (3, 4, 5)] == ["und"] * 3 and und[15] != "und"
    assert language_id.train(empty) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[50:80] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    graph = neighbours.NeighbourGraph.build(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = graph.search(graph.members.where("vec_id % 50 = 0").selectExpr("vec_id as query_id")).collect()
    found = sum_ = 0
    for q in range(0, 300, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and np.allclose([m[2] for m in mine], d[[m[1] for m in mine]])
        found += len(set(want) & {m[1] for m in mine})
        sum_ += 10
    assert found >= 0.9 * sum_


def nearest_share(spark, x, queries, k=10):
    """Share of the true ``k`` nearest that a search finds, and its rows."""
    graph = neighbours.NeighbourGraph.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = graph.search(graph.members.where(F.col("vec_id").isin(queries)).selectExpr("vec_id as query_id"), k).collect()
    found = 0
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]
        found += len(set(want) & {r["vec_id"] for r in got if r["query_id"] == q})
    return found / (k * len(queries)), got


def test_neighbours_near_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1400, 64))
    x[:1200] = x[0] + rng.normal(size=(1200, 64)) * 1e-5 * np.linalg.norm(x[0]) / 8
    x[1399, 5] = 1e8  # one outlier
    share, _ = nearest_share(spark, x, list(range(0, 1400, 70)))
    print("recall among near copies", share)
    assert share >= 0.9


def test_neighbours_more_partitions_than_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        share, got = nearest_share(spark, np.random.default_rng(3).normal(size=(25, 4)), [0, 7, 24])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert share == 1 and len(got) == 30


def test_neighbours_few_and_ragged(spark):
    x = np.random.default_rng(5).normal(size=(6, 3))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, [1.0]), (8, [1.0, 2.0, 3.0, 4.0]), (9, []), (None, [1.0, 2.0, 3.0]), (10, [1.0, None, 2.0])]
    graph = neighbours.NeighbourGraph.build(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = graph.search(graph.members.selectExpr("vec_id as query_id")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, k) for q in range(6) for k in range(1, 6)]
    none = neighbours.NeighbourGraph.build(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert none.search(none.members.selectExpr("vec_id as query_id")).count() == 0


def test_battery_tells_random_strings(spark):
    rng = np.random.default_rng(6)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    keys = ["".join(rng.choice(letters, int(n))) for n in rng.integers(24, 90, 400)]
    words = ["section", "chapter", "article", "release", "version", "invoice", "customer", "number"]
    names = ["/".join(f"{rng.choice(words)}{rng.integers(9)}" for _ in range(int(n))) for n in rng.integers(3, 9, 1200)]
    texts = [f"see {v} here" for v in [*keys, *names]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    flagged = {r["doc_id"] for r in secret_scan.scan(docs).collect() if r["added"]}
    true = sum(i < len(keys) for i in flagged)
    assert true >= 0.7 * len(keys) and len(flagged) - true <= 0.15 * len(flagged)
    only_names = secret_scan.scan(docs.where(f"doc_id >= {len(keys)}"))
    assert sum(bool(r["added"]) for r in only_names.collect()) <= 0.02 * len(names)


def test_secrets(docs, rows, empty):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in secret_scan.scan(docs).collect()}
    for i, text, *_ in rows:
        t = text or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i] == sorted(want)
    assert secret_scan.scan(empty).count() == 0


def test_quality(docs, rows, brute, empty):
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    for i, text, *_ in rows:
        w, seen, dup = brute.words(text), set(), 0
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        for line in (text or "").split("\n"):
            if brute.words(line):
                dup += line in seen
                seen.add(line)
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))
        assert g["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (g["base_failed"] and g["kept"])
    assert quality.quality_verdicts(empty).count() == 0


def test_sketch_quantiles(spark):
    values = np.random.default_rng(7).lognormal(1, 1, 4000)
    table = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "part int, x double")
    parts = quality.quantile_sketch(table, ["part"], ["x"])
    merged = quality.sketch_quantiles(quality.merge_sketches(parts, []), [], (0.25, 0.5, 0.9)).first()
    assert merged["count"] == 4000
    for i, share in enumerate((0.25, 0.5, 0.9)):
        assert abs(merged[f"q{i}"] / np.quantile(values, share, method="inverted_cdf") - 1) <= 0.011


def test_quality_follows_each_group(spark):
    rng, rows = np.random.default_rng(8), []
    word = lambda n: "".join(rng.choice(list("abcdefghij"), int(n)))
    for source, spread in (("narrow", (5, 7)), ("wide", (1, 24))):
        for _ in range(120):
            size = rng.integers(*spread)
            rows.append((len(rows), " ".join(word(size) for _ in range(40)), "aa", source))
    twin = " ".join(word(16) for _ in range(40))
    rows += [(9001, twin, "aa", "narrow"), (9002, twin, "aa", "wide")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[9001] and got[9002]


def test_quality_planted_outliers(spark):
    rng, rows, bad, n = np.random.default_rng(4), [], {}, 0
    line = lambda: " ".join("abcdefgh"[int(k) % 3 : int(k)] + f"{rng.integers(100):02}" for k in rng.integers(4, 8, 5))
    for lang in ("aa", "bb", None):
        for source in ("s1", "s2", None):
            texts = [[line() for _ in range(int(rng.integers(20, 40)))] for _ in range(220)]
            banner = [x for k in range(50) for x in (line(), "the same banner of five")]  # half the lines
            window = [line() for _ in range(60)] + ["one two three four five six seven eight"] * 8  # 15 % of the words
            symbols = [f"{x} ###" for x in (line() for _ in range(30))]
            longer = [" ".join(f"{w}longerword" for w in line().split()) for _ in range(30)]
            for kind, t in [*((None, t) for t in texts), ("banner", banner), ("window", window), ("symbols", symbols), ("longer", longer)]:
                n += 1
                rows.append((n, "\n".join(t), lang, source))
                if kind:
                    bad[n] = kind
    got = {r["doc_id"]: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {i: k for i, k in bad.items() if got[i]["kept"]} == {}
    assert sum(r["kept"] for r in got.values()) >= 0.99 * (n - len(bad))


def test_repeats(docs, rows, empty):
    got = {r["doc_id"]: r for r in suffix_dedup.cut_repeats(docs).collect()}
    seen = set()
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                cover[p : p + 100] = True
            seen.add(b[p : p + 100])
        assert got[i]["kept"] == np.frombuffer(b, np.uint8)[~cover].tobytes() and got[i]["n_removed"] == cover.sum()
    assert suffix_dedup.cut_repeats(empty).count() == 0


def test_token_files(spark, docs, rows, empty, tmp_path):
    for table, name in ((docs, "some"), (empty, "none")):
        token_files.write_token_files(table, f"file://{tmp_path}/{name}", PATH)
    got, at = {r["doc_id"]: r for r in token_files.read_token_files(spark, f"file://{tmp_path}/some").collect()}, 0
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        e = ids(text, 1)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(e), zlib.crc32(e.tobytes()))
        at += len(e)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 99), max_size=600), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks(values, share):
    v = np.array(values, np.uint32)
    page = token_files.encode_blocks(v, share)
    assert (token_files.decode_blocks(len(v), page) == v).all()
    if len(v) > 256:
        assert (token_files.decode_blocks(len(v), page, 1, 2) == v[128:256]).all()


def test_lines(docs, rows, brute, empty):
    key = lambda line: brute.lower(line.strip(" \t\n\x0b\f\r"))
    own = {}
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            own.setdefault(k, set()).add(i)
    own = {k: min(v) for k, v in own.items() if len(v) > 1 and len(k) >= 10}
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    for i, text, *_ in rows:
        kept = [x for x in (text or "").split("\n") if own.get(key(x), i) == i]
        assert got[i]["text"] == "\n".join(kept)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_index_is_reversible(spark):
    table = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    one, two = table((1, "a line that is long\nown line of one")), table((2, "a line that is long\nown line of two"))
    _, index = line_dedup.LineIndex(spark, shards=3).insert(one)
    index = index.saved()
    verdict, both = index.insert(two)
    assert [tuple(r) for r in verdict.collect()] == [(2, [0])]
    both = both.saved()
    back = both.delete(table((1, "")))
    verdict, _ = back.insert(table((3, "a line that is long\nown line of one")))
    assert [tuple(r) for r in verdict.collect()] == [(3, [0])]  # document 2 still holds the first line, nobody the other
    gone = back.delete(table((2, "")))
    assert gone.references.count() == 0 and gone.insert(one)[0].count() == 0


def test_line_index_keeps_colliding_keys(spark):
    names = spark.range(5000).selectExpr("concat('line number ', id) AS text").withColumn("h1", F.xxhash64("text")).collect()
    prints, one, two = line_dedup.CuckooFilter(16)._places(np.array([r["h1"] for r in names], np.int64).view(np.uint64))
    held, pair = {}, None
    for i, k in enumerate(zip(prints.tolist(), np.minimum(one, two).tolist(), strict=True)):
        pair = (names[held[k]]["text"], names[i]["text"]) if k in held else pair
        held[k] = i
    table = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=1).insert(table(1, pair[0]))[1].saved()
    index = index.insert(table(2, pair[1]))[1].saved()
    for gone, left, text in ((1, 2, pair[1]), (2, 1, pair[0])):
        verdict, _ = index.delete(table(gone, "")).insert(table(3, text))
        assert [tuple(r) for r in verdict.collect()] == [(3, [0])], left


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_cuckoo(keys):
    k = np.array(sorted(keys), np.uint64)
    f = line_dedup.CuckooFilter.for_keys(len(k))
    assert f.insert(k) and f.contains(k).all()
    f.remove(k)
    assert not f.table.any()


def test_packing(docs, rows, empty):
    out = sorted(packing.pack_documents(docs, PATH, length=64, windows=3).collect(), key=lambda r: (r["doc_id"], r["start"]))
    fill = Counter()
    for i, text, *_ in rows:
        e, at = ids(text, 2), 0
        for r in (r for r in out if r["doc_id"] == i):
            assert r["start"] == at and r["doc_tokens"] == len(e) and r["ids_crc32"] == zlib.crc32(e[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(e)
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 64 and packing.pack_documents(empty, PATH).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("aAbÉé.,! '<|>\n\x00\x1c\x85\u00a0ΣςİıſΆ\u0345\u0301\u0323×÷中1²ªµ½·…’—가", max_size=40))
def test_encoder(text):
    assert CachedEncoder_.encode_batch([text])[0] == ids(text, 0)[:-1].tobytes()


def test_encoder_over_all_planes():
    letters = [chr(c) for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000] + ["×", "÷", "\u0345", "\u0301"]
    texts = [f"a{c}. {c}B, {c}" for c in letters] + ["5 ×. then", "a ÷, b", "Ά\u0345", "IT'S. ok's, 'S.", "<|endoftext|> X. y"]
    assert CachedEncoder(PATH, 5000).encode_batch(texts) == [ids(t, 0)[:-1].tobytes() for t in texts]


CachedEncoder_ = CachedEncoder(PATH, 500)


def test_extra_columns(docs):
    inner = "_id _doc _lines _at _copies id doc lines at parts copies copy k h f lang_pred score2 n_lines kept".split()
    named = docs.selectExpr("*", *[f"'{c}' AS {c}" for c in inner])
    n = docs.count()
    assert line_dedup.dedup_lines(named).count() == suffix_dedup.cut_repeats(named).count() == language_id.identify(named, None).count() == n
    assert quality.quality_verdicts(named).count() == n
    assert jaccard_join.one_of_each_group(named).columns == source_mix.mixed_documents(named).columns == named.columns
    assert jaccard_join.one_of_each_group(named).count() < n
    assert {r["at"] for r in line_dedup.dedup_lines(named).collect()} == {"at"}


def test_index_rebuilds_full_filters(spark):
    batch = lambda first, n: spark.range(first, first + n).selectExpr("id AS doc_id", "concat('some long line ', id) AS text")
    index = line_dedup.LineIndex(spark, shards=2).insert(batch(0, 40))[1].saved()
    index = index.insert(batch(1000, 3000))[1].saved()  # far beyond the first tables
    assert index.filters.where("table IS NULL").isEmpty() and index.filters.count() == 2
    again = batch(0, 40).unionByName(batch(1000, 3000)).selectExpr("doc_id + 100000 AS doc_id", "text")
    verdicts, _ = index.insert(again)
    assert verdicts.count() == 3040
    index = index.delete(batch(1000, 3000))
    assert index.insert(again)[0].count() == 40


def test_chain_grows():
    chain = line_dedup.FilterChain(line_dedup.CuckooFilter(16))
    keys = np.random.default_rng(9).integers(0, 1 << 63, 5000, dtype=np.uint64)
    met = np.concatenate([chain.meet(keys[at : at + 100]) for at in range(0, 5000, 100)])
    assert met.mean() < 0.01 and chain.meet(keys).all() and len(chain.filters) > 2


def test_small_ids_are_unpacked_from_two_bytes(monkeypatch):
    seen, plain = [], np.unpackbits
    monkeypatch.setattr(np, "unpackbits", lambda a, **k: seen.append(a.shape[-1]) or plain(a, **k))
    for top, most in ((49_000, 2), (1 << 32, 4)):
        v = np.random.default_rng(5).integers(0, top, 1000, dtype=np.uint64).astype(np.uint32)
        seen.clear()
        page = token_files.encode_blocks(v)
        assert max(seen) == most
        assert (token_files.decode_blocks(len(v), page) == v).all()


def test_chunks_of_a_batch_outlast_a_change_of_generations():
    from quarrylane.llm.tokens import CachedEncoder

    small, texts = CachedEncoder(PATH, limit=6), ["one two three", None, "two four, five 6", "", "one seven eight nine ten two"]
    assert small.encode_batch(texts) == small.encode_batch(texts) == [small._whole(t or "") for t in texts]
