"""Segments of composite files against a plain fold, and single operators that SQL doesn't reach."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarrylane.functions import records, text
from quarrylane.operators import classify, costs, pages
from quarrylane.plans.classify_queries import _page_table

SF = "/root/testdata/sf0.001"


def folded(rows):
    done, now = [], None
    for r in rows:
        i = r["identity"]
        same = now and ((r["start"] == "customs_export_ead" and i["mrn"] and i["mrn"] == now["id"]["mrn"]) or (r["start"] == "commercial_invoice" and i["invoice_no"] and i["invoice_no"] == now["id"]["invoice_no"]))
        bounded = r["start"] is not None and not same
        weak = r["n_chars"] < 100 or r["confidence"] < 0.4
        clash = now and any(i[k] and now["id"][k] and i[k] != now["id"][k] for k in ("mrn", "invoice_no"))
        if now and not bounded and not clash and (weak or r["type"] is None or r["type"] == now["type"] or now["bounded"]):
            n = r["page"] - now["first"] + 1
            now["confidence"] = (now["confidence"] * (n - 1) + (now["confidence"] if weak else r["confidence"])) / n
            now["last"] = r["page"]
            if not any(now["id"].values()):
                now["id"] = dict(i.asDict())
        else:
            now = {"type": r["start"] if bounded else r["type"], "first": r["page"], "last": r["page"], "confidence": max(r["confidence"], 0.6) if bounded else r["confidence"], "bounded": bounded, "id": dict(i.asDict())}
            done.append(now)
    return done


def test_segments(spark):
    table = _page_table(spark, SF)
    want, files = set(), {}
    for r in table.collect():
        files.setdefault(r["file"], []).append(r)
    several = {}
    for file, rows in files.items():
        own = folded(sorted(rows, key=lambda r: r["page"]))
        several[file] = len(own) >= 2 and any(s["bounded"] or (s["type"] and s["confidence"] >= 0.5) for s in own)
        for k, s in enumerate(own):
            want.add((file, k + 1, s["type"], s["first"], s["last"], math.floor(s["confidence"] * 1000 + 0.5) / 1000, s["bounded"]))
    split = pages.split_pages(table).cache()
    got = {(r["file"], r["segment"], r["type"], r["first"], r["last"], r["confidence"], r["bounded"]) for r in split.collect()}
    assert got == want and len({w[0] for w in want}) < len(want)
    assert {r["file"]: r["several"] for r in pages.several_documents(split).collect()} == several


def test_chunks(spark):
    texts = ["a,b,c\n" * 70 + "end", "x" * 30 + "\nshort", "", "one\ntwo", "l" * 11 + "\n" + "m" * 3]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.chunks(F.col("t"), 12, 3)).collect()]
    for t, c in zip(texts, got, strict=True):
        assert "".join(c).replace("\n", "") == t.replace("\n", "") and all(len(x) <= 12 + 12 for x in c)
    whole = spark.createDataFrame([(texts[0],)], "t string").select(text.chunks(F.col("t"))).first()[0]
    assert [x.count("a,b,c") for x in whole] == [30, 30, 10]


def test_entities(spark):
    rows = [("&#1055;&#x1F600;&amp;lt; &lt;b&gt; &#99999999; &#0; plain",)]
    assert spark.createDataFrame(rows, "t string").select(text.decode_entities(F.col("t"))).first()[0] == "П😀&lt; <b>   plain"


def test_nested_tables(spark):
    html = "<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>"
    out = spark.createDataFrame([(html,)], "t string").select(text.html_to_markdown(F.col("t"))).first()[0]
    assert "| a | b | | --- | | c |".replace(" ", "") in out.replace(" ", "").replace("\\|", "|") or "b" in out


def test_schema_helpers():
    assert records.schema_leaves({"properties": {"a": {}, "b": {"properties": {"c": {}, "d": {}}}, "e": {"items": {"properties": {"f": {}}}}, "g": {"items": {}}}}) == 5
    assert records.schema_leaves(None) == records.schema_leaves({"properties": 3}) == 0
    assert records.pick_name_field(["unitPrice", "goodsTitle", "productName"]) == "productName"
    assert classify.keyword_rules("x", ["a", "(", "b"], [2.0, 1.0, None], 0.5) == [("x", "a", 2.0), ("x", "b", 0.5)]


def test_costs_without_exchange_rate(spark):
    rates = spark.createDataFrame([("p", "USD", "vendor", 1.0, 1.0, None, None)], costs.RATES)
    jobs = spark.createDataFrame([(1, "p", 1000, 0, 2, None, None, False)], "id int, model string, prompt int, output int, unknown_calls int, ocr string, pages int, tables boolean")
    row = costs.breakdown(jobs, rates, None).first()
    assert row["total"] == 0 and row["reasons"] == ["calls without token counts", "no exchange rate"]
