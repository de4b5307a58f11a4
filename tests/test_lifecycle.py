"""Review by actions against a fold, inboxes, second extractions, merged objects and lists."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quarrylane.operators import lifecycle as lc

JOBS = "id int, status string, extracted string, issues array<string>, corrected_at int"
ACTIONS = "id int, at int, seq int, action string, extracted string, reason string"


def fold(job, actions):
    i, status, record, issues, at = job
    issues = None if issues is None else list(issues)
    for _, when, _, action, new, reason in sorted(actions, key=lambda a: a[1:3]):
        if action == "approve" and status == "needs_review":
            status, at = "done", when if at is None else at
        elif action in ("correct", "draft"):
            record, issues, at = new, None, when
            status = "done" if action == "correct" else status
        elif action == "flag" and status in ("done", "needs_review"):
            status, issues = "needs_review", [*(issues or []), reason]
    return i, status, record, issues, at


def test_review_equals_a_fold(spark):
    r = random.Random(5)
    jobs = [(i, r.choice(["done", "needs_review", "failed", "pending"]), r.choice([None, "r"]), r.choice([None, [], ["x"]]), r.choice([None, 3])) for i in range(300)]
    actions = [(r.randrange(320), r.randrange(4), s, r.choice(["approve", "correct", "draft", "flag", "flag", "nod"]), r.choice([None, f"n{s}"]), f"why{s}") for s in range(1200)]
    actions += [(299, 5, 2000 + s, "flag", None, "again") for s in range(300)]
    got = {x["id"]: tuple(x) for x in lc.review(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(actions, ACTIONS)).collect()}
    assert len(got) == 300
    for job in jobs:
        assert got[job[0]] == fold(job, [a for a in actions if a[0] == job[0]]), job
    assert lc.review(spark.createDataFrame([], JOBS), spark.createDataFrame(actions, ACTIONS)).count() == 0
    assert {tuple(x) for x in map(lambda x: (x["id"], x["status"]), lc.review(spark.createDataFrame(jobs, JOBS), spark.createDataFrame([], ACTIONS)).collect())} == {j[:2] for j in jobs}


def test_inbox(spark):
    inbox = spark.createDataFrame([(i, 100 - i, 1 if i == 4 else None, 10 if i == 5 else i, "old") for i in range(8)], "event_id int, received_at int, processed_at int, attempts int, last_error string")
    assert [r["event_id"] for r in lc.pending_events(inbox, limit=4).collect()] == [7, 6, 3, 2]
    results = spark.createDataFrame([(1, None), (2, "e" * 600), (3, None), (3, "bad"), (99, None)], "event_id int, error string")
    out = {r["event_id"]: tuple(r)[2:] for r in lc.settle(inbox, results, F.lit(50)).collect()}
    assert len(out) == 8 and out[1] == (50, 1, None) and out[2] == (None, 3, "e" * 500) and out[3] == (None, 4, "bad") and out[0] == (None, 0, "old")


def test_merged_objects(spark):
    rows = [(None, None), ('{"a": 1, "b": {"c": [1, 2]}}', '{"b": null, "d\\"e": "x"}'), ("[1]", '{"z": true}'), ("no json", None), ('{"a": 1.5}', "{}")]
    out = [json.loads(r[0]) for r in spark.createDataFrame(rows, "a string, b string").select(lc.merge_object(F.col("a"), F.col("b"))).collect()]
    assert out == [{}, {"a": 1, "b": None, 'd"e': "x"}, {"z": True}, {}, {"a": 1.5}]


def test_lists(spark):
    rows = spark.createDataFrame([(i, "done" if i % 2 else "failed", str(i % 3), "application/pdf" if i % 5 else "image/png", f"f_{i}.pdf", i % 4, i % 6, i, "770700%04d" % i) for i in range(60)], "id int, status string, doc_type string, mime string, file_name string, tenant int, project int, created_at int, inn string")
    ids = lambda on: [r["id"] for r in rows.where(on).orderBy("id").collect()]
    assert ids(lc.wanted("done", ["1", "2"], ["image"], numbers=["inn"])) == [i for i in range(60) if i % 2 and i % 3 and i % 5 == 0]
    assert ids(lc.wanted(tenant=1, project=3, since=10, until=50, numbers=["inn"])) == [i for i in range(10, 51) if i % 4 == 1 and i % 6 == 3]
    assert ids(lc.wanted(text=" f_1 ", numbers=["inn"])) == [1, *range(10, 20)]
    assert ids(lc.wanted(text="7707000012", numbers=["inn"])) == [12]
    assert ids(lc.wanted(text=" ", numbers=["inn"])) == list(range(60))
    assert lc.visible(rows, projects=[]).count() == 0 and lc.visible(rows, tenant=1, projects=[1, 5]).count() == 10 and lc.visible(rows).count() == 60
    assert [r["id"] for r in lc.page(rows, [F.desc("created_at")], 3, 2).collect()] == [57, 56, 55]


def test_second_extraction(spark):
    q = "struct<score:double,factors:array<string>,again:boolean>"
    first = [
        (1, "multipass", (1.0, ["truncated_json"], True), 3, "a"), (2, "retry", (1.5, ["empty_extract"], True), 3, "a"), (3, "retry", (1.0, ["reasoning_bleed"], True), 3, "a"),
        (4, "keep", (0.6, ["confident_sparse"], False), 3, "a"), (5, "keep", (1.0, ["truncated_json"], True), 3, "a"), (6, "retry", (1.0, ["truncated_json"], True), 3, "a"),
    ]
    second = [(1, (0.0, [], False), 9, "b"), (2, (1.5, ["empty_extract"], True), 2, "b"), (3, (1.0, ["truncated_json"], True), 3, "b"), (4, (0.0, [], False), 0, "b")]
    out = lc.choose_extraction(spark.createDataFrame(first, f"id int, plan string, quality {q}, n_missing int, extracted string"), spark.createDataFrame(second, f"id int, quality {q}, n_missing int, extracted string"))
    got = {r["id"]: (r["chosen"], r["extracted"], r["n_missing"], r["factors"]) for r in out.collect()}
    assert got == {
        1: ("second", "b", 9, []), 2: ("second", "b", 2, ["empty_extract"]), 3: ("first", "a", 3, ["reasoning_bleed"]),
        4: ("first", "a", 3, []), 5: ("first", "a", 3, ["truncated_json"]), 6: ("first", "a", 3, ["truncated_json"]),
    }
