"""Keyword rules of scopes, the fall-through to built-in ones, and the say of file names."""

from __future__ import annotations

from quarrylane.operators import classify

TYPES = "scope string, slug string, keywords array<string>, weights array<double>, weight double, active boolean"
DOCS = "id int, scope string, text string, name string"


def found(spark, docs, types):
    out = classify.classify_scoped(spark.createDataFrame(docs, DOCS), spark.createDataFrame(types, TYPES)).collect()
    return {r["id"]: r for r in out}


def test_own_rules_come_before_builtin_ones(spark):
    types = [
        ("a", "note", ["memo\\s+no", "(", "plain"], [2.0, 3.0, None], 0.7, True),
        ("a", "other", ["memo"], None, None, True),
        ("b", "note", ["never"], [], None, True),
        ("a", "off", ["memo"], [9.0], None, False),
        (None, "all", ["everywhere"], [], 0.4, True),
    ]
    far = "x" * 600
    docs = [
        (1, "a", "Memo  no 5", "scan.pdf"), (2, "a", "plain счёт №", None), (3, "a", "счёт № 5", None), (4, "b", "memo, упд", None), (5, "b", "everywhere", None),
        (6, None, far + " everywhere", None), (7, "a", None, None), (8, "a", "", "ТТН_3.pdf"), (9, "a", far + " memo plain", "awb 7.pdf"),
    ]
    r = found(spark, docs, types)
    assert (r[1]["slug"], r[1]["score"], r[1]["matched"], r[1]["candidates"], r[1]["rules"]) == ("note", 1.0, "Memo  no", 2, "own")
    assert [(x["slug"], x["score"]) for x in r[1]["ranked"]] == [("note", 1.0), ("other", 1.0)]
    assert (r[2]["slug"], round(r[2]["score"], 4), r[2]["rules"]) == ("note", 1.0, "own")  # 0.7 * 1.5, one at most
    assert (r[3]["slug"], r[3]["rules"], r[3]["candidates"]) == ("invoice", "builtin", 2)
    assert (r[4]["slug"], r[4]["rules"]) == ("UPD", "builtin")
    assert (r[5]["slug"], round(r[5]["score"], 4), r[5]["rules"]) == ("all", 0.6, "own")
    assert (r[6]["slug"], round(r[6]["score"], 4)) == ("all", 0.4)
    assert (r[7]["slug"], r[7]["score"], r[7]["ranked"], r[7]["rules"]) == (None, 0.0, None, None)
    assert (r[8]["slug"], r[8]["matched"], r[8]["rules"]) == ("TTN", "filename:TTN", None)
    assert (r[9]["slug"], r[9]["matched"], [x["slug"] for x in r[9]["ranked"]]) == ("awb", "filename:awb", ["awb", "other", "note"])


def test_ties_and_empty_tables(spark):
    types = [("a", "zz", ["ab"], [], None, True), ("a", "aa", ["cd"], [], None, True)]
    r = found(spark, [(1, "a", "ab cd", None), (1, "a", "ab cd", None)], types)
    assert r[1]["slug"] == "aa"
    assert found(spark, [], types) == {}
    assert found(spark, [(1, "a", "упд", None)], [])[1]["slug"] == "UPD"


def test_word_edges_are_ascii(spark):
    types = [("a", "w", [r"\bcmr\b"], [], None, True), ("a", "back", [r"x\\b"], [], 0.2, True)]
    docs = [(1, "a", "жCMRж", None), (2, "a", "xcmr", None), (3, "a", "cmr", None), (4, "a", "x\\b", None)]
    r = found(spark, docs, types)
    assert [r[i]["slug"] for i in (1, 2, 3, 4)] == ["w", None, "w", "back"]
    plain = classify.classify(spark.createDataFrame([d[::2] for d in docs], "id int, text string"), [("w", r"\bcmr\b", 1.0), ("back", r"x\\b", 0.2)])
    assert {x["id"]: x["slug"] for x in plain.collect()} == {1: "w", 2: None, 3: "w", 4: "back"}


def test_plain_keywords_are_sought_as_their_patterns_match(spark):
    words = ["kilos", "ın line", "два  слова", r"a\s+ \s+b", "x.y", r"\s+end", "(?s)Q", "", "ж"]
    types = [("a", f"t{i}", [w], [], None, True) for i, w in enumerate(words)]
    texts = ["KİLOſ", "IN LINE", "ДВА  СЛОВА", "два слова", "A \n\t B", "a  b", "a b", "xzY", "the end", "the\x0bEND", "q", "", "ᲀ Ж", "İ ß ς", None]
    got = {r["id"]: {x["slug"] for x in r["ranked"] or []} for r in classify.classify_scoped(spark.createDataFrame([(i, "a", t, None) for i, t in enumerate(texts)], DOCS), spark.createDataFrame(types, TYPES)).collect()}
    pairs = spark.createDataFrame([(i, f"t{j}", t or "", "(?iu)" + w) for i, t in enumerate(texts) for j, w in enumerate(words)], "i int, slug string, t string, p string")
    want = {i: set() for i in range(len(texts))}
    for r in pairs.where("regexp_instr(t, p) > 0").collect():
        want[r["i"]].add(r["slug"])
    assert got == want
    rule = classify.rules_by_scope(spark.createDataFrame(types, TYPES))[0].first()["own"]
    assert [r["sought"] for r in rule if r["slug"] in ("t0", "t2", "t3", "t4")] == ["kilos", "два слова", "a b", ""]


def test_documents_are_dealt_out(spark):
    from quarrylane.plans.queries import QUERIES
    from test_queries import SF

    assert "REPARTITION_BY_NUM" in QUERIES["scoped_types"](spark, SF)._jdf.queryExecution().executedPlan().toString()
