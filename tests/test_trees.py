"""Match signals, recovered taxpayer numbers and canonical answers on single records."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarrylane.functions import answers, recover, signals

FINAL = {"schema_version": "1.2", "document_stage": "final"}
SELLER, BUYER, BANK = "7722753969", "7811472920", "7707083893"
BL, CI = "bill_of_lading", "commercial_invoice"

SIGNALS = [
    (None, None, {}),
    ("TTN", {}, {}),
    (BL, {"number": "", "containers": [], "shipper": {"name": "   "}, "date": None}, {}),
    (
        BL,
        {"number": " FITFL8771877 ", "date": "2026-06-03", "shipped_on_board": "2026-06-01", "shipper": {"name": "Anji", "inn": "7728168971"}, "consignee": {"name": "EWL", "kpp": "772801001"}, "notify_party": {"name": "N"}, "containers": [{"number": "FITU8888881", "seal": "X1"}, {"number": "not-a-container"}, {"number": "FITU8888881"}, 5, "x"]},
        {"bl_number": "FITFL8771877", "containers": ["FITU8888881"], "parties": {"shipper": {"name": "Anji", "inn": "7728168971"}, "consignee": {"name": "EWL", "kpp": "772801001"}, "notify_party": {"name": "N"}}, "dates": {"document": "2026-06-03", "shipped_on_board": "2026-06-01"}},
    ),
    (BL, {"bl_number": "LEGACY"}, {}),
    (BL, {"number": "B", "containers": [{"container_number": "MSCU1234567"}]}, {"bl_number": "B", "containers": ["MSCU1234567"]}),
    (BL, {"containers": [{"number": "mrku1234567 40HC"}, {"number": "GESU765432145G1"}, {"number": "TCLU 7654321"}, {"number": "AB CD1234567"}]}, {"containers": ["MRKU1234567", "GESU7654321", "TCLU7654321"]}),
    (
        "packing_list",
        {"exporter": {"name": "A"}, "consignee": {"name": "C"}, "seller": {"name": "S"}, "containers": [{"number": "CAIU7958712", "gross_weight": "14 000,5", "weight_net": 12000, "volume": 33.1, "places": 679}, {"number": "FESU5360805"}, {"number": "CAIU7958712", "packages": 1}]},
        {"containers": ["CAIU7958712", "FESU5360805"], "container_details": [{"number": "CAIU7958712", "gross_weight_kg": 14000.5, "net_weight_kg": 12000.0, "volume_m3": 33.1, "packages": 679.0}], "parties": {"seller": {"name": "A"}, "buyer": {"name": "C"}}},
    ),
    (
        "TTN",
        {"number": "50_1", "shipper": {"name": "O"}, "carrier": {"inn": "7707083893"}, "vehicle": {"plate": "X716TT797", "trailer_plate": "ЕК451577"}, "order_refs": ["Order ABC-1"]},
        {"ttn_number": "50_1", "vehicle": {"plate": "Х716ТТ797", "trailer": "ЕК451577"}, "parties": {"shipper": {"name": "O"}, "carrier": {"inn": "7707083893"}}, "order_refs": ["Order ABC-1"]},
    ),
    ("TTN", {"vehicle": {"plate": "no plate"}}, {"vehicle": {"plate": "no plate"}}),
    ("transport_invoice", {"number": "7", "forwarder": {"name": "F"}}, {"ttn_number": "7", "parties": {"forwarder": {"name": "F"}}}),
    (
        "invoice",
        {"number": "I", "seller": {"name": "П", "inn": "7728168971", "kpp": "772801001"}, "total": 16280.0, "currency": "USD", "vat": 0, "order_ref": "IMP-1877", "containers": [{"number": "MSCU1234567"}], "vehicle": {"trailer": "T"}},
        {"parties": {"seller": {"name": "П", "inn": "7728168971", "kpp": "772801001"}}, "totals": {"amount": 16280.0, "currency": "USD", "vat": 0.0}, "order_refs": ["IMP-1877"], "vehicle": {"trailer": "T"}},
    ),
    ("factInvoice", {"buyer": {"name": "B"}, "total_with_vat": "1 100,5", "currency": "RUB"}, {"parties": {"buyer": {"name": "B"}}, "totals": {"amount": 1100.5, "currency": "RUB"}}),
    ("invoice", {"total_amount": 5, "currency": "RUB"}, {"totals": {"currency": "RUB"}}),
    ("contract", {"total_amount": 5, "currency": "RUB"}, {"totals": {"amount": 5.0, "currency": "RUB"}}),
    ("invoice", {"total": "", "total_with_vat": 7}, {"totals": None}),
    ("upd", {"order_refs": ["PO-1", "  ", "PO-1", 3], "order_number": "PO-2", "items": [{"order_ref": "PO-3"}, {"order_ref": " PO-1 "}], "positions": [{"order_ref": "PO-4"}]}, {"order_refs": ["PO-1", "PO-2", "PO-3", "PO-4"]}),
    (CI, {"items": [{"container_no": "TCLU7654321"}], "container_number": "GESU7654321"}, {"containers": ["TCLU7654321", "GESU7654321"]}),
    ("CMR", {"number": "C", "consignor": None, "sender": {"name": "S"}, "recipient": {"name": "R"}, "container": {"number": "MSCU1234567"}}, {"cmr_number": "C", "parties": {"shipper": {"name": "S"}, "consignee": {"name": "R"}}, "containers": ["MSCU1234567"]}),
    ("wire_transfer_application", {"amount": 50000, "currency": "CNY", "sender_name": "EWL", "sender": {"inn": "7728168971"}, "beneficiary_name": "A"}, {"parties": {"payer": {"name": "EWL", "inn": "7728168971"}, "payee": {"name": "A"}}, "totals": {"amount": 50000.0, "currency": "CNY"}}),
    ("payment_order", {"payer": {"name": "P"}, "payee": "text", "amount": 1}, {"parties": {"payer": {"name": "P"}}, "totals": {"amount": 1.0}}),
    ("customs_declaration", {"declaration_number": "D", "sender": {"name": "S"}, "recipient": {"name": "R"}, "total_value": 3}, {"declaration_numbers": ["D"], "parties": {"seller": {"name": "S"}, "buyer": {"name": "R"}}, "totals": {"amount": 3.0}}),
    ("AKT", {"party_a": {"name": "E", "inn": "1"}, "customer": {"name": "K"}, "_field_confidence": {"party_a.inn": 0.9, "party_b.inn": "x", "date": 1}}, {"parties": {"executor": {"name": "E", "inn": "1"}, "customer": {"name": "K"}}, "_confidence": {"parties.executor": 0.9}}),
    ("contract", {"total": 100, "currency": "RUB", "_field_confidence": {"total": 0.77, "seller.inn": 1}}, {"totals": {"amount": 100.0, "currency": "RUB"}, "_confidence": {"totals.amount": 0.77}}),
    ("proforma_invoice", {}, {"document_stage": "proforma"}),
    (CI, {"document_stage": "DRAFT"}, {"document_stage": "draft"}),
    ("invoice", {"document_stage": "Proforma invoice"}, {"document_stage": "proforma"}),
    (BL, {"bl_type": "MASTER", "master_bl_number": "no"}, {"bl_type": "Master"}),
    (BL, {"bl_type": "HBL", "master_bl_number": "MSCU"}, {"bl_type": "House", "master_bl_number": "MSCU"}),
    (BL, {"bl_type": "SWB", "release_type": "TELEX RELEASE"}, {"bl_type": "Sea Waybill", "release_type": "telex_release"}),
    (BL, {"bl_type": "что-то", "number_of_original_bls": 3}, {"release_type": "original", "number_of_original_bls": 3}),
    (BL, {"number_of_original_bls": 0}, {"number_of_original_bls": 0}),
    (BL, {"number_of_original_bls": 2.5, "release_type": "?"}, {}),
    ("invoice", [1, 2], {}),
]


def test_match_signals(spark):
    rows = [(i, t, None if r is None else json.dumps(r)) for i, (t, r, _) in enumerate(SIGNALS)]
    df = spark.createDataFrame(rows, "i int, t string, j string")
    got = {r.i: json.loads(r.s) for r in df.select("i", F.to_json(signals.match_signals(F.try_parse_json("j"), F.col("t"))).alias("s")).collect()}
    for i, (t, record, want) in enumerate(SIGNALS):
        assert got[i] == {k: v for k, v in {**FINAL, **want}.items() if v is not None}, (t, record)


ASK = {"seller.inn": "не указан", "buyer.inn": "не указан"}
WINDOWS = [
    (ASK, f"Поставщик: ООО «В», ИНН {SELLER}, КПП 997750001\nПокупатель: ООО «Т», ИНН {BUYER}, КПП 784201001", {"seller.inn": SELLER, "buyer.inn": BUYER}),
    (ASK, f"Поставщик: ООО «А»\nПокупатель: ООО «Б», ИНН {BUYER}", {"buyer.inn": BUYER}),
    ({"seller.inn": "7728168971"}, f"Поставщик: ООО «А», ИНН {SELLER}", {}),
    (ASK, "Поставщик: ООО «А», ИНН 1234567890", {}),
    ({"seller.inn": ""}, f"ПОСТАВЩИК: ООО «А» ИНН/КПП {SELLER}/997750001", {"seller.inn": SELLER}),
    ({}, f"Грузополучатель: ООО «Б», ИНН {BUYER}", {"consignee.inn": BUYER}),
    (ASK, None, {}),
    (ASK, "", {}),
    (ASK, f"ИНН {SELLER} без сторон", {}),
    (ASK, f"Поставщик: SIA B\nБанк получателя: ПАО СБЕРБАНК\nИНН {BANK}", {}),
    (ASK, f"Поставщик: ООО «Р», ИНН {SELLER}\nБанк получателя ИНН {BANK}\nПокупатель: ООО «Б», ИНН {BUYER}", {"seller.inn": SELLER, "buyer.inn": BUYER}),
    ({"seller.country": " lv "}, f"Поставщик: SIA B, ИНН {SELLER}", {}),
    ({"seller.country": "RU"}, f"Поставщик: B, ИНН {SELLER}", {"seller.inn": SELLER}),
    ({}, f"Продавец {'x' * 400} ИНН {SELLER}", {}),
    ({}, f"Продавец: A, ИНН 1. Поставщик: B, ИНН {SELLER}; Заказчик ИНН: № {BUYER} Плательщик БИК 044 ИНН {BUYER} Перевозчик БИК0 ИНН {BUYER}", {"seller.inn": SELLER, "buyer.inn": BUYER, "payer.inn": BUYER}),
]


def test_recovered_inns(spark):
    df = spark.createDataFrame([(i, r, t) for i, (r, t, _) in enumerate(WINDOWS)], "i int, r map<string,string>, t string")
    got = df.select("i", recover.recovered_inns(F.col("r"), F.col("t")).alias("found"), recover.recover_inns(F.col("r"), F.col("t")).alias("all")).collect()
    for r in got:
        record, text, want = WINDOWS[r.i]
        assert (r.found, r["all"]) == (want, {**record, **want}), text


RAW = [
    ({"extracted": {"number": "A-1"}, "confidence": 0.9, "issues": [], "more": 1}, {"extracted": {"number": "A-1"}, "confidence": 0.9, "issues": [], "more": 1}),
    (
        {"seller": {"name": "Р", "inn": SELLER}, "buyer": {"name": "И"}, "invoice_details": {"invoice_number": "01-2", "date": "18.05.2026", "total_amount": 522.5, "empty": ""}},
        {"extracted": {"seller": {"name": "Р", "inn": SELLER}, "buyer": {"name": "И"}, "number": "01-2", "date": "18.05.2026", "total": 522.5}},
    ),
    ({"seller": {"inn": "7"}, "payment_details": {"account_number": "4", "bank_name": "Б", "bic": "044", "recipient_account_number": "3", "other": 1}}, {"extracted": {"seller": {"inn": "7", "account": "4", "bank": "Б", "bik": "044", "corr_account": "3"}}}),
    ({"extracted": {"number": "9", "seller_inn": "7", "buyer_inn": "8", "seller_name": "П", "buyer": {"inn": "1"}}}, {"extracted": {"number": "9", "seller": {"inn": "7", "name": "П"}, "buyer": {"inn": "1"}}}),
    ({"extracted": {"seller": "text", "seller_inn": "7"}}, {"extracted": {"seller": {"inn": "7"}}}),
    ({"extracted": {"party1": {"name": "И", "inn": ""}, "customer": {"name": "З", "kpp": "5"}, "buyer": {"name": "", "inn": "2"}}}, {"extracted": {"seller": {"name": "И", "inn": ""}, "buyer": {"name": "З", "kpp": "5", "inn": "2"}}}),
    ({"extracted": {"number": "X", "positions": [{"name": "т", "qty": 1}], "items": []}}, {"extracted": {"number": "X", "positions": [{"name": "т", "qty": 1}], "items": [{"name": "т", "qty": 1}]}}),
    ({"extracted": {"number": "CANON", "invoice_details": {"invoice_number": "STRAY"}}}, {"extracted": {"number": "CANON"}}),
    ({}, {}),
    ({"confidence": 0.0}, {"confidence": 0}),
    ("garbage", {"extracted": {}}),
    ({"confidence": 0.5, "field_confidence": {"number": 1.5}, "number": "A"}, {"confidence": 0.5, "field_confidence": {"number": 1.5}, "extracted": {"number": "A"}}),
    ({"extracted": {"currency": "USD", "total": {"amount": 100, "currency": "RUB"}}}, {"extracted": {"currency": "USD", "total": 100}}),
    ({"extracted": {"total_with_vat": {"value": 1200.5}, "vat": {"sum": 200.5, "currency": "RUB"}}}, {"extracted": {"total_with_vat": 1200.5, "vat": 200.5, "currency": "RUB"}}),
    ({"extracted": {"total": {"foo": "bar"}, "vat": {"amount": True, "currency": "RUB"}}}, {"extracted": {"total": {"foo": "bar"}, "vat": {"amount": True, "currency": "RUB"}}}),
    ({"extracted": {"items": [{"name": "т", "total": {"amount": 50.5, "currency": "EUR"}, "price": {"value": 25}}, 7, None]}}, {"extracted": {"currency": "EUR", "items": [{"name": "т", "total": 50.5, "price": 25}, 7, None]}}),
    ({"extracted": {"a": {"b": [{"c": [1, {"d": None}]}]}, "n": None, "invoice": {"document": {"number": "D"}}}}, {"extracted": {"a": {"b": [{"c": [1, {"d": None}]}]}, "n": None, "number": "D"}}),
    ({"extracted": 5, "confidence": 1}, {"extracted": 5, "confidence": 1}),
    ({"extracted": {}, "invoice": {"number": "2"}}, {"extracted": {"number": "2"}}),
]


def test_canonical_answers(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(RAW)], "i int, j string")
    once = df.select("i", F.to_json(answers.canonical_answer(F.col("j"))).alias("j"))
    rows = once.collect()
    for r in rows:
        assert json.loads(r.j) == RAW[r.i][1], RAW[r.i][0]
    again = spark.createDataFrame(rows).select("i", F.to_json(answers.canonical_answer(F.col("j"))).alias("k"), "j").collect()
    assert all(json.loads(r.k) == json.loads(r.j) for r in again)


def test_answers_that_are_no_json(spark):
    df = spark.createDataFrame([("{bad",), (None,), ("",)], "j string")
    assert {r[0] for r in df.select(F.to_json(answers.canonical_answer(F.col("j")))).collect()} == {'{"extracted":{}}'}
