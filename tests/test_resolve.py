"""Fuzzy matches of every part against brute force."""

from __future__ import annotations

from quarrylane.operators import resolve
from quarrylane.plans.queries import QUERIES


def grams(name):
    words = "".join(c if c.isalnum() else " " for c in name.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def test_fuzzy_match_covers_all_parts(spark):
    sf = "/root/testdata/sf0.001"
    parts = [(r["p_partkey"], r["p_name"], grams(r["p_name"])) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    want = set()
    for i, _, g in parts:
        scored = sorted((-len(g & h) / len(g | h), name, j) for j, name, h in parts if len(g & h) / len(g | h) >= 0.3)
        want |= {(i, j, round(-score, 6), k + 1) for k, (score, _, j) in enumerate(scored[:5])}
    got = {(r["id"], r["entry_id"], r["score"], r["rank"]) for r in QUERIES["fuzzy_match_all"](spark, sf).collect()}
    assert got == want and {g[0] for g in got} == {p[0] for p in parts}


def test_similar_names_lose_none(spark):
    """All pairs of generated names by plain Python; the filters leave far fewer than all pairs to measure."""
    import random

    rng = random.Random(3)
    words = ["steel", "wheel", "bolt", "bolts", "nut", "large", "small", "red", "blue", "widget", "gadget", "x1", "x12", "ab"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(260)})
    left, right = spark.createDataFrame([(n,) for n in names[::2]], "name string"), spark.createDataFrame([(n,) for n in names[1::2]], "display_name string")
    grams = {n: {f"  {w} "[i : i + 3] for w in n.split() for i in range(len(w) + 1)} for n in names}
    for threshold in (0.3, 0.6):
        want = {(a, b): round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 9) for a in names[::2] for b in names[1::2] if len(grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b]) - 1e-12}
        got = {(r.name, r.display_name): round(r.score, 9) for r in resolve.similar_names(left, right, threshold).collect()}
        assert got == want and resolve.name_candidates(left, right, threshold)[0].count() < len(names) ** 2 / 4
