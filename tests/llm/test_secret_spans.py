"""Spans of texts with many matches, which are summed up in blocks."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quarrylane.llm import queries, secret_scan


def test_spans_of_many_matches(spark):
    r = random.Random(3)
    texts = []
    for n in (0, 1, 2, 255, 256, 257, 511, 512, 513, 1500):
        words = ["".join(r.choice("0123456789abcdef") for _ in range(r.choice([5, 23, 24, 40]))) if r.random() < 0.1 else "0" * 24 for _ in range(n)]
        texts.append(r.choice(["", "é🙂 "]) + " ".join(f"{w} token={'x' * (i % 9 + 1)} ü" for i, w in enumerate(words)))
    frame = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, t string")
    out = frame.select("i", secret_scan.match_spans(F.coalesce("t", F.lit("")), secret_scan.HEX, 2).alias("hex"), secret_scan.match_spans(F.coalesce("t", F.lit("")), secret_scan.ASSIGN, 0, 2, 6).alias("assign")).collect()
    for row in out:
        t = dict([*enumerate(texts), (99, "")])[row["i"]]
        assert [tuple(x) for x in row["hex"]] == [(m.start(), 2, m.end()) for m in re.finditer(secret_scan.HEX, t)]
        assert [tuple(x) for x in row["assign"]] == [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN, t) if len(m.group(2)) >= 6]


def test_counts_are_those_of_each_kind(spark, tmp_path):
    a, h = "AKIA" + "Z9" * 8, "0f" * 12
    texts = [None, "", f"{h} {h} {h}", f"{a},{a}", f"{h} token=abcdef {a} {h} passwd: 123456 secret=xy", "api_key='abcdefgh'"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"]) for r in queries.op5_secret_scan(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 0), 2: (0, 0, 3), 3: (0, 2, 0), 4: (2, 1, 2), 5: (1, 0, 0)}
