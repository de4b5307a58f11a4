"""The verdicts of op6 on a whole table against plain Python."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from quarrylane.llm import quality
from quarrylane.llm.queries import op6_quality

SF = "/root/testdata/sf0.01"
GROWTH = 1.01 / 0.99


def spread_of(cells, fence=3.5):
    n = sum(cells.values())
    value = {c: 0.0 if c == 0 else 1e-3 * GROWTH ** (c - 0.5) for c in cells}
    upto, median = 0, None
    for c in sorted(cells):
        upto += cells[c]
        if upto >= n * 0.5:
            median = value[c]
            break
    square = {c: (value[c] - median) ** 2 for c in cells}
    whole = sum(cells[c] * square[c] for c in cells) / n
    near = [c for c in cells if square[c] <= fence**2 * whole]
    return n, median, max(math.sqrt(sum(cells[c] * square[c] for c in near) / sum(cells[c] for c in near)), 0.02 * median)


def limits_of(levels, fence=3.5, prior=50.0):
    out = None
    for cells in reversed(levels):  # all documents, the language, the group
        n, median, spread = spread_of(cells)
        own = (median - fence * spread, median + fence * spread)
        out = own if out is None else tuple((n * a + prior * b) / (n + prior) for a, b in zip(own, out, strict=True))
    return out


def test_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in quality.with_shares(quality.text_counts(docs)).collect()]
    sketches = defaultdict(Counter)
    for r in rows:
        r["base"] = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        for m, _ in quality.METRICS if not r["base"] else ():
            cell = 0 if r[m] <= 1e-3 else max(0, math.ceil(math.log(r[m] / 1e-3) / math.log(GROWTH)))
            for key in ((r["lang"], r["source"]), (r["lang"],), ()):
                sketches[(m, *key)][cell] += 1
    want = {}
    for r in rows:
        kept = not r["base"]
        for m, both in quality.METRICS:
            levels = [sketches[(m, *key)] for key in ((r["lang"], r["source"]), (r["lang"],), ())]
            if kept and all(levels):
                low, high = limits_of(levels)
                kept = r[m] <= high and (r[m] >= low or not both)
        want[r["doc_id"]] = (r["base"], kept)
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in op6_quality(spark, SF).collect()}
    assert got == want and 0 < sum(not k and not b for b, k in want.values()) < len(want) / 4


def test_limits_follow_their_groups(spark):
    """Hardly any group's limit is the same as another's."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    shares = quality.with_shares(quality.text_counts(docs)).where("n_words >= 20")
    wide = quality.adaptive_limits(quality.quantile_sketch(shares, ["lang", "source"], [m for m, _ in quality.METRICS]), 3.5, 50.0).collect()
    for m, _ in quality.METRICS:
        assert len({round(r[f"_{m}"]["high"], 9) for r in wide}) >= 0.9 * len(wide)
