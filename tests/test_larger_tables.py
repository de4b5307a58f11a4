"""Queries on tables with larger keys, longer spans of time and many equal names, against their SQL."""

from __future__ import annotations

import json

from datetime import datetime, timedelta

import duckdb
import pytest

from pyspark.sql import functions as F

from quarrylane.functions import checks, invoice, signals, text, values
from quarrylane.operators import resolve, tables
from quarrylane.plans.queries import ORACLES, QUERIES
from test_queries import SF, TABLES, rows


@pytest.fixture
def same(spark, tmp_path):
    """Holds a query against its SQL over the smallest tables, some of them replaced by a SELECT of them."""

    def check(name: str, **replaced: str) -> int:
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t}_ AS SELECT * FROM '{SF}/{t}.parquet'")
            con.execute(f"COPY ({replaced.get(t, f'SELECT * FROM {t}_')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        want = rows(con.execute(ORACLES[name]).df())
        got = rows(QUERIES[name](spark, str(tmp_path)).toPandas())
        num = lambda v: sorted(str(tuple(float(x) if isinstance(x, float) or str(x).lstrip("-").replace(".", "", 1).isdigit() else x for x in r)) for r in v)
        assert num(got) == num(want)
        return len(want)

    return check


def test_commodity_codes_of_larger_part_keys(same):
    assert same("canonical_fields", lineitem="SELECT * REPLACE (l_partkey + 123456 AS l_partkey) FROM lineitem_ WHERE l_orderkey < 200")


def test_content_is_reused_within_240_hours(spark, tmp_path):
    at = datetime(2024, 1, 1)
    events = [(i, at + timedelta(hours=h), 3, kind, 1.0, '{"k": 1}') for i, (h, kind) in enumerate([(0, "purchase"), (200, "view"), (240, "view"), (239, "view")])]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(tuple, QUERIES["ttl_dedup"](spark, str(tmp_path)).collect())) == [(1, 0), (3, 0)]


def test_links_are_chosen_before_entries_are_joined(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 3)
    values = [(1, 0, "gone"), (1, 1, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (3, 0, None), (3, None, "a"), (4, 0, "c"), (4, 0, "c")]
    entries = [(i, ["a", "a"] if i % 2 else ["a", "b"]) for i in range(20)] + [(20, ["c"]), (21, None)]
    frame = spark.createDataFrame(values, "id long, place int, value string").withColumn("field", F.lit("f"))
    links = resolve.exact_links(frame, spark.createDataFrame(entries, "entry_id long, keys array<string>"))
    want = [(i, e, "exact") for i in (1, 2) for e in range(20)] + [(3, None, "not_found"), (4, 20, "exact")]
    assert sorted(map(str, map(tuple, links.collect()))) == sorted(map(str, want))
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id#" not in plan.split("Union")[0] and plan.count("explode(e#") == 2  # entries come last, in blocks


def test_links_are_written_in_blocks(spark, tmp_path):
    entries = spark.range(4000).select(F.col("id").alias("entry_id"), F.array(F.concat(F.lit("n"), (F.col("id") % 2).cast("string"))).alias("keys"))
    frame = spark.range(3000).select("id", F.lit(0).alias("place"), F.concat(F.lit("n"), (F.col("id") % 3).cast("string")).alias("value"), F.lit("f").alias("field"))
    links = resolve.exact_links(frame, entries)
    links.write.parquet(str(tmp_path / "links"))
    read = spark.read.parquet(str(tmp_path / "links"))
    assert read.distinct().count() == read.count() == 2 * 1000 * 2000 + 1000
    assert sum(f.stat().st_size for f in (tmp_path / "links").glob("*.parquet")) < read.count() // 2  # with ids and entries in any order four bytes a link and more
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("REPARTITION") + plan.count("RepartitionByExpression") >= 2 and plan.index("explode(ids#") < plan.index("collect_list(id#")  # ids and entries are opened last


def test_a_key_sends_its_first_entries_alone(spark):
    entries = spark.createDataFrame([(i, f"n{i % 3}", ["k", "k", f"o{i}"]) for i in range(60)], "entry_id long, display_name string, keys array<string>")
    wanted = spark.createDataFrame([(1, ["k", "o1", "o2"]), (2, ["o59", None]), (3, ["none"])], "id long, values array<string>")
    found = resolve.overlap_search(wanted, entries)
    assert sorted(map(tuple, found.collect())) == [(1, 3 * i) for i in range(10)] + [(2, 59)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2  # the rest of a key ends before the join


def test_costly_reads_are_dealt_out(spark):
    one = QUERIES["invoice_fields"](spark, SF)
    assert "RepartitionByExpression" in one._jdf.queryExecution().optimizedPlan().toString()


ODD = """оГРН: 1027700132195|огрн №102770013219|БИК 044525225|бИк:№044525225|р/с 40702810900000000001|расчётный счёт 40702810900000000002|рс 40702810900000000003|x 40702810900000000004|к/с № 30101810400000000225|по\u00a0Заявке IMP-2026-001
Основание: AB-2025-0123|гос. номер А123ВС77|ᲄС: К001КК199|авто В222ОР50|маршрут: г. Рига → Нижний Новгород|НАПРАВЛЕНИЕ Москва – Минск|откуда - куда: Псков -> г. Тверь|спецразрешение № 77-2026-12345|РАЗРЕШЕНИЯ 1-2025-999|оплатить до 1.2.2026|Срок оплаты: 12/03/2026
оплата до 5-6-2027|действует до 03.12.2026|действительно 1.1.2027|VALİD until 2.2.2026|срок действия 9.9.2029|man tgx 18.440|камаз-5490|İveco|goldhofer STZ-1|Низкорамный трал|12-осный|5 осей|3 осевой|Росавтодор|_ГИБДД|20,5 тоннx|20.5 Тx|1500 кгx|10 x 3.8 × 4 м|10Х3х4м
Габариты 10|РАЗМЕР груза|негабаритный|КРУПНОГАБАРИТ|тяжеловес|Груз: станки и прочее|перевозимый груз — трубы|сопровождение по лесной участок|эскорт на весь маршрут|патруль ГИБДД|машинаx прикрытия|лоцман-водитель|наличными|caſh|банковскийx перевод|безналично|б/нx|бнx|banK transfer
предоплата|АВАНС|prepay|постоплата|оплата после|postpay|картой|карта|CARD|жд|ж.д.|железнодорожный|морской|ſea|vesſel|авиа|aİr freight|САМОЛЁТ|таможенный|cuſtoms|растаможка|автотранспорт|тягач|фура|ФУРУ"""


def test_invoice_patterns_are_tried_where_their_words_stand(spark):
    frame = spark.createDataFrame([(t, u) for t in ODD.replace("\n", "|").split("|") for u in (t, t.upper(), f"x\n{t}\n")], "one string, t string")
    patterns = [*invoice.HOLDS, *invoice.LOOKS]
    guard = lambda i: invoice._Text(F.col("t"), text.one_case(F.col("t"))).may(patterns[i])
    hit = lambda i: F.col("t").rlike(f"(?iu){patterns[i]}")
    row = frame.agg(*[F.count_if(hit(i)).alias(f"n{i}") for i in range(len(patterns))], *[F.count_if(hit(i) & ~guard(i)).alias(f"m{i}") for i in range(len(patterns))]).first()
    assert not [p for i, p in enumerate(patterns) if row[f"m{i}"] or not row[f"n{i}"]]
    x = spark.range(1).select(invoice.invoice(F.lit("ᲄС: К001КК199, İveco, 10 x 3,8 × 4 м, aİr freight, caſh")).alias("x")).first().x
    assert (x.vehicle.plate, x.vehicle.model, x.payment_method, x.transport.route.leg_kind, x.transport.cargo.dimensions.width_m) == ("К001КК199", "İveco", "cash", "air", 3.8)


def test_merged_items_are_dealt_by_document_once(spark):
    plan = QUERIES["merge_chunks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in plan


def test_types_are_ranked_within_rows(spark):
    plan = QUERIES["classify_business_text"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "RepartitionByExpression" in plan


def _tree_plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_answers_are_read_from_orders_dealt_out_once(spark):
    plan = _tree_plan(spark, "canonical_answers")
    assert plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" in plan  # no single task of a broadcast join
    assert plan.count("Exchange hashpartitioning(") == 2  # lines, and orders to them


def test_records_are_opened_once_and_dealt_out_by_order(spark):
    plan = _tree_plan(spark, "diff_records")
    assert plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" in plan
    assert "map_zip_with" in plan and "array_union" not in plan  # leaves are paired by key, not sought for each path


def test_null_leaves_differ_from_missing_ones(spark):
    rows = [(1, '{"a": null, "b": {"c": []}, "d": 2e3}', '{"b": {"c": [null, {"e": 1.5}]}, "d": 2000}'), (2, "5", None), (3, "[1]", "[null]")]
    got = tables.diff_records(spark.createDataFrame(rows, "id int, old string, new string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a", None, None), (1, "b.c.0", None, None), (1, "b.c.1.e", None, "1.5"), (3, "0", "1", None)]))


def test_letters_are_read_from_orders_dealt_out(spark):
    one = QUERIES["recovered_inns"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in one
    digits = spark.range(1).select(values.inn_valid(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert digits.count("regexp_replace") == 1  # a number's digits are read once, not for each weight


def test_signals_are_read_from_orders_dealt_out_once(spark):
    plan = _tree_plan(spark, "match_signals")
    assert plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" in plan


def test_signals_open_a_record_in_one_pass(spark):
    plan = _tree_plan(spark, "match_signals")
    assert "$['seller']" not in plan and "$['total']" not in plan  # no path is sought from the top for each rule
    one = spark.range(1).select(checks.plate(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("upper(") == 1  # a plate's text is made once, not for each of its parts


def test_signals_of_odd_members(spark):
    rows = [
        ("CMR", {"consignor": None, "sender": {"name": " F ", "inn": 5}, "consignee": "text", "recipient": {"name": "T"}, "carrier": [1], "total": "x", "total_with_vat": 9}),
        ("wire_transfer_application", {"sender": {"name": "A", "inn": "1"}, "sender_name": None, "beneficiary_name": " ", "amount": " 1 000,5 "}),
        ("TTN", {"containers": [None, 3, {"number": "none", "container_number": "msku 1234567", "gross_weight": "x", "weight_gross": 4}, {"number": "MSKU1234567", "volume": 2}], "items": "no", "container": {"number": "TGHU7654321"}}),
    ]
    df = spark.createDataFrame([(i, t, json.dumps(r)) for i, (t, r) in enumerate(rows)], "i int, t string, j string")
    got = {r.i: json.loads(r.s) for r in df.select("i", F.to_json(signals.match_signals(F.try_parse_json("j"), F.col("t"))).alias("s")).collect()}
    assert got[0]["parties"] == {"shipper": {"name": "F"}} and "totals" not in got[0]
    assert got[1]["parties"] == {"payer": {"name": "A", "inn": "1"}} and got[1]["totals"] == {"amount": 1000.5}
    assert got[2]["containers"] == ["TGHU7654321", "MSKU1234567"] or got[2]["containers"] == ["MSKU1234567", "TGHU7654321"]
    assert got[2]["container_details"] == [{"number": "MSKU1234567", "gross_weight_kg": 4.0}]
