"""Leaves of trees, differences of records, categories by a table, headers, gates and the whole summary of jobs."""

from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylane.functions import trees
from quarrylane.operators import metrics, tables, totals

KEYS = st.sampled_from(["a", "b", "c d", "é", "_issues", "x"])
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.sampled_from(["", "x", "1.0", 'q"']), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(KEYS, inner, max_size=3), max_leaves=12)


def plain(value, path=""):
    if isinstance(value, dict):
        return [x for k, v in value.items() if k != "_issues" for x in plain(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in plain(v, f"{path}.{i}" if path else str(i))]
    return [(path, value if value is None or isinstance(value, str) else str(value).lower())] if path else []


@settings(max_examples=4, deadline=None)
@given(st.lists(VALUES, min_size=40, max_size=60))
def test_leaves(spark, values):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    got = {r["i"]: sorted(map(tuple, r["l"]), key=str) for r in spark.createDataFrame(rows, "i int, j string").select("i", trees.leaves(F.col("j"), ["_issues"]).alias("l")).collect()}
    for i, v in enumerate(values):
        assert got[i] == sorted(plain(v), key=str)


def test_leaves_deep_and_odd(spark):
    rows = [(0, "[" * 300 + "7" + "]" * 300), (1, "none"), (2, None), (3, "{}"), (4, "[2e3, 1.50, 0.1, 5]")]
    got = {r["i"]: r["l"] for r in spark.createDataFrame(rows, "i int, j string").select("i", trees.leaves(F.col("j")).alias("l")).collect()}
    assert [tuple(x) for x in got[0]] == [(".".join(["0"] * 300), "7")] and got[1] is None and got[2] is None and got[3] == []
    assert [x["value"] for x in got[4]] == ["2000", "1.5", "0.1", "5"]


def test_differences(spark):
    rows = [
        (1, '{"a": 1, "b": [1, 2], "_issues": [1]}', '{"a": 1.0, "b": [1], "c": {"d": null}}'), (2, None, '{"a": "x"}'), (3, '{"a": null}', "{}"), (4, '{"a": {"b": 1}}', '{"a": 5}'),
        (5, "5", "6"), (6, '{"a.b": 1, "a": {"b": 2}}', '{"a": {"b": 2}}'), (7, '{"a": null}', '{"a": null}'),
    ]
    got = sorted(tuple(r) for r in tables.diff_records(spark.createDataFrame(rows, "id int, old string, new string")).collect())
    assert got == [(1, "b.1", "2", None), (1, "c.d", None, None), (2, "a", None, "x"), (3, "a", None, None), (4, "a", None, "5"), (4, "a.b", "1", None)]


def test_categories(spark):
    items = spark.createDataFrame([(1, "Steel bolt", None), (2, "bolt", "own"), (3, "milk bolt", "other"), (4, None, ""), (5, "", None), (6, "steel milk cheese", None)], "id int, text string, preset string")
    words = spark.createDataFrame([("metal", 1, "steel"), ("metal", 1, "steel"), ("metal", 1, "bolt"), ("food", 0, "milk"), ("food", 0, "cheese"), ("odd", 2, "")], "category string, priority int, word string")
    got = {r["id"]: r["category"] for r in tables.categorize_by(items, words).collect()}
    assert got == {1: "metal", 2: "own", 3: "food", 4: "other", 5: "other", 6: "food"}
    assert {r["category"] for r in tables.categorize_by(items, words.limit(0)).collect()} == {"own", "other"}


def test_headers(spark):
    heads = [(1, None, 120.0, None, 20.0, None), (2, 110.0, None, 100.0, None, None), (3, None, None, 5.0, None, None), (4, 100.0, None, 0.0, 7.0, None), (5, 120.0, None, None, 13.0, 5.0), (6, 118.0, None, None, 18.01, None)]
    items = spark.createDataFrame([(2, 10.0), (2, 18.0), (3, 5.0)], "doc int, rate double")
    got = {r["doc"]: tuple(r)[1:] for r in totals.derive_header(spark.createDataFrame(heads, "doc int, total double, total_with_vat double, net double, vat double, rate double"), items).collect()}
    assert got[1] == (120.0, 100.0, 20.0, 20.0, ["total", "net", "rate"])
    assert got[2] == (110.0, 100.0, 10.0, 18.0, ["vat", "rate"])
    assert got[3] == (None, 5.0, None, None, [])
    assert got[4] == (100.0, 0.0, 7.0, None, [])
    assert got[5] == (120.0, 107.0, 13.0, 5.0, ["net"])
    assert got[6] == (118.0, 99.99, 18.01, 18.0, ["net", "rate"])


def test_gates(spark):
    found = spark.createDataFrame([("a", "x", 0.8), ("a", "y", 0.1), ("b", "x", 0.5)], "by string, field string, recall double")
    limits = spark.createDataFrame([("a", "x", 0.7), (None, "x", 0.5), (None, "x", 0.4)], "by string, field string, least double")
    assert sorted((r["by"], r["field"], r["least"], r["passed"]) for r in tables.recall_gate(found, limits).collect()) == [("a", "x", 0.7, True), ("a", "y", None, True), ("b", "x", 0.5, True)]


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([], "status string, latency double, confidence double, issues array<string>, tokens_in double, tokens_out double, model_ms double, used_model boolean")
    row = metrics.operational(none, hours=24).first()
    assert (row["total"], row["p95"], row["done_rate"], row["per_hour"], row["model_ms_p95"]) == (0, None, 0.0, 0.0, None)
