"""The pipeline's stages over the smallest tables, each against plain Python on its own input."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarrylane.llm.common import staged

DOCS = "/root/testdata/sf0.001/documents.parquet"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_hand_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\f\r"))
    own = {}
    for r in rows:
        for k in {key(x) for x in r["text"].split("\n")}:
            own.setdefault(k, set()).add(r["doc_id"])
    out = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if len(key(x)) < 10 or min(own[key(x)]) == r["doc_id"]) for r in rows}
    return {i: t for i, t in out.items() if t}


def by_hand_groups(rows):
    sets, label = {}, {}
    for r in rows:
        w = words(lower(r["text"]))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        label[r["doc_id"]] = r["doc_id"]
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return {i for i, v in label.items() if i == v}


def test_stages(spark):
    docs = spark.read.parquet(DOCS)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "jaccard_join", "source_mix", "packing"]

    def run(name, docs):
        out = staged(stages[name](spark, docs, ""), name)
        return out, out.collect()

    rows = docs.collect()
    known, got = run("language_id", docs)
    assert known.columns == docs.columns
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "")}
    given = {r["doc_id"]: r["lang"] for r in rows}
    assert all(r["lang"] == given[r["doc_id"]] or given[r["doc_id"]] is None and r["lang"] for r in got)

    lines, kept = run("line_dedup", known)
    assert lines.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept} == by_hand_lines(got)
    assert all(r["n_chars"] == len(r["text"]) for r in kept)

    single, got = run("jaccard_join", lines)
    assert single.columns == docs.columns and {r["doc_id"] for r in got} == by_hand_groups(kept)

    mixed, copies = run("source_mix", single)
    n, size, total = Counter(r["doc_id"] for r in copies), {r["doc_id"]: len(words(r["text"])) for r in got}, Counter()
    assert mixed.columns == docs.columns and max(n.values()) <= 3 and set(n) <= set(size)
    for r in got:
        total[r["source"]] += size[r["doc_id"]]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, free = {}, set(total)
    while True:
        level = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            break
        target |= {s: 3 * total[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    took = Counter()
    for r in copies:
        took[r["source"]] += size[r["doc_id"]]
    largest = {s: max(size[r["doc_id"]] for r in got if r["source"] == s) for s in target}
    assert all(abs(took[s] - target[s]) <= largest[s] for s in target)  # a source has ten documents at most here

    _, pieces = run("packing", mixed)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids, fill, seen = {}, Counter(), Counter()
    for r in copies:
        ids[r["doc_id"]] = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        e = ids[r["doc_id"]]
        assert r["offset"] == fill[r["sequence_id"]] and r["doc_tokens"] == len(e)
        assert r["ids_crc32"] == zlib.crc32(e[r["start"] : r["start"] + r["length"]].tobytes())
        fill[r["sequence_id"]] += r["length"]
        seen[r["doc_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and seen == {i: n[i] * len(ids[i]) for i in n}


def test_corpus_without_labels(spark):
    rows = [(1, "plain words", None), (2, "12 34", None), (3, None, "en"), (4, "ελ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted(map(tuple, got)) == [(1, "plain words", None), (4, "ελ", None)]


def test_empty_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, _id string, lines string"
    rows = [(None, "some words without an id here", "en", None, 1, "a", "b"), (5, "the same words twice in this row", "en", "s", 1, "a", "b"), (5, "the same words twice in this row", "en", "s", 1, "a", "b"), (6, None, None, None, None, None, None), (7, "", "en", "s", 0, "", "")]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, ""), name)
            assert docs.columns == table.columns
        ids = Counter(r["doc_id"] for r in docs.collect())
        assert set(ids) <= {None, 5} and max(ids.values(), default=0) <= 6
        pieces = corpus_pipeline.pack(spark, docs, "").where(F.col("doc_id") == 5).agg(F.sum("length")).first()[0]
        assert (pieces or 0) % 8 == 0
