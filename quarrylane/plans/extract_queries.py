"""Fields found in texts, normalised records and their validation. Inputs are made from the tables' keys, and the SQL says
what the keys plant there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks as ck
from ..functions import fields as fd
from ..functions import invoice as inv
from ..functions import records as rc
from ..functions import text as tx
from ..functions import values as vl
from ..operators import costs
from ..operators.layout import spread
from ..sources.views import table
from .queries import query


def pick(key: Column, values: Sequence[object]) -> Column:
    """One of the values by the key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def sql_pick(key: str, values: Sequence[object]) -> str:
    text = ["NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v) for v in values]
    return f"[{', '.join(text)}][CAST(({key}) % {len(values)} + 1 AS INTEGER)]"


def record(**fields: Column) -> Column:
    """A record of the fields that aren't null; two underscores stand for a dot."""
    pairs = [F.struct(F.lit(k.replace("__", ".")).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))


MONTH_LIST = "['" + "', '".join(fd.MONTHS) + "']"
#: Ten digits with a right check digit from a customer's key.
INN_SQL = """(SELECT c_custkey AS k, b || ((2 * b[1]::INT + 4 * b[2]::INT + 10 * b[3]::INT + 3 * b[4]::INT + 5 * b[5]::INT + 9 * b[6]::INT + 4 * b[7]::INT + 6 * b[8]::INT + 8 * b[9]::INT) % 11 % 10)::VARCHAR AS inn FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 9, '7') AS b FROM customer) x)"""


def _inn(key: Column) -> Column:
    base = F.lpad(key.cast("string"), 9, "7")
    return F.concat(base, vl._check(base, vl.INN_10).cast("string"))


# ---- fields in texts ----


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN lpad(o_orderkey::VARCHAR, 12, '5') ELSE lpad(o_orderkey::VARCHAR, 10, '7') END AS inn, lpad(o_orderkey::VARCHAR, 9, '1') AS kpp, 'АБ-' || o_orderkey || '/' || o_orderkey % 100 AS number,
 CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '20%y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, round(o_totalprice, 2) AS total, 20 AS vat_rate, o_orderkey % 1000 + 1.5::DOUBLE AS vat FROM orders""")
def find_fields(spark, sf):
    o, k, d = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    named = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(F.array(*map(F.lit, fd.MONTHS)), F.month(d)), F.year(d).cast("string"))
    day = F.when(k % 3 == 0, F.date_format(d, "d.M.yy")).when(k % 3 == 1, F.date_format(d, "d-MM-yyyy")).otherwise(named)
    inn = F.when(k % 5 == 0, F.lpad(k.cast("string"), 12, "5")).otherwise(F.lpad(k.cast("string"), 10, "7"))
    lines = [F.concat(F.lit("Счёт на оплату № АБ-"), k, F.lit("/"), k % 100, F.lit(" от "), day), F.concat(F.lit("Поставщик ИНН: "), inn, F.lit(" КПП "), F.lpad(k.cast("string"), 9, "1"))]
    lines += [F.lit("Итого 20%"), F.concat(F.lit("Итого: "), F.format_number("o_totalprice", 2), F.lit(" руб.")), F.lit("Цена без НДС 7"), F.concat(F.lit("в т.ч. НДС 20 %: "), k % 1000 + 1, F.lit(",50"))]
    t = o.select("o_orderkey", F.concat_ws("\n", *lines).alias("t"))
    x = F.col("t")
    return t.select("o_orderkey", fd.find_inn(x).alias("inn"), fd.find_kpp(x).alias("kpp"), fd.find_doc_number(x, "счёт|счет").alias("number"), fd.find_date(x).alias("day"), fd.find_money(x, r"всего\s+к\s+оплате", "итого").alias("total"), fd.find_vat_rate(x).alias("vat_rate"), fd.find_vat(x).alias("vat"))


@query("""SELECT s_suppkey, s_suppkey || '-У' AS number, '2025-02-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') AS date, 1000 + s_suppkey + 0.25::DOUBLE AS total, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey + 0.1::DOUBLE END AS vat, lpad(s_suppkey::VARCHAR, 10, '7') AS seller, CASE WHEN s_suppkey % 4 > 0 THEN lpad(s_suppkey::VARCHAR, 12, '5') END AS buyer FROM supplier""")
def transfer_document(spark, sf):
    k = F.col("s_suppkey")
    lines = [F.concat(F.lit("УПД № "), k, F.lit("-У от "), k % 28 + 1, F.lit(".02.2025")), F.concat(F.lit("Продавец, ИНН "), F.lpad(k.cast("string"), 10, "7")), F.when(k % 4 > 0, F.concat(F.lit("Покупатель, ИНН № "), F.lpad(k.cast("string"), 12, "5")))]
    lines += [F.concat(F.lit("Всего к оплате: "), 1000 + k, F.lit(",25")), F.when(k % 3 > 0, F.concat(F.lit("НДС "), k, F.lit(",10"))).otherwise(F.lit("Без НДС"))]
    return table(spark, sf, "supplier").select("s_suppkey", fd.transfer_document(F.concat_ws("\n", *lines)).alias("u")).select("s_suppkey", "u.*")


@query("""SELECT p_partkey, round(1 - ((p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT) / 3, 6) AS confidence, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'brand' END, CASE WHEN p_partkey % 3 = 0 THEN 'type' END) AS missing FROM part""")
def field_completeness(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    c = fd.completeness({"brand": F.when(k % 2 > 0, F.col("p_brand")), "type": F.when(k % 3 > 0, F.col("p_type")).otherwise(""), "size": k})
    return p.select("p_partkey", F.round(c["confidence"], 6).alias("confidence"), F.array_join(c["missing"], ",").alias("missing"))


@query("""SELECT event_id, CASE WHEN value / 1000 > 0.7 OR event_id % 7 = 0 OR value / 1000 >= (user_id % 10) / 10 THEN 'pattern' ELSE 'model' END AS parser FROM events""")
def choose_parser(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", fd.choose_parser(F.col("value") / 1000, F.when(F.col("event_id") % 7 > 0, (F.col("user_id") % 10) / 10)).alias("parser"))


@query("""SELECT p_partkey, lpad(p_partkey::VARCHAR, 6, '8') || ',12345678' AS kept, CASE WHEN p_partkey % 2 = 0 THEN 'n/a' ELSE '' END AS dropped,
 '12345678' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',' || lpad(p_partkey::VARCHAR, 10, '4') END AS recovered, 'MSKU' || lpad(p_partkey::VARCHAR, 7, '0') AS containers FROM part""")
def codes_in_text(spark, sf):
    k = F.col("p_partkey")
    codes = F.array(F.lpad(k.cast("string"), 6, "8"), F.lit("1234 56 78"), F.lit("12345678"), F.when(k % 2 == 0, F.lit(" n/a ")).otherwise(F.lit("")))
    own = F.lpad(k.cast("string"), 10, "4")
    words = F.concat(F.lit("Код ТН ВЭД: "), F.substring(own, 1, 4), F.lit(" "), F.substring(own, 5, 2), F.lit(" "), F.substring(own, 7, 3), F.lit(" "), F.substring(own, 10, 1), F.lit("; цена 999 999 999"))
    text = F.concat(words, F.lit("\nКонтейнер № msku"), F.lpad(k.cast("string"), 7, "0"), F.lit(", контейнера MSKU"), F.lpad(k.cast("string"), 7, "0"))
    clean = fd.clean_hs_codes(codes)
    doc_type = F.when(k % 3 == 0, "invoice").otherwise("packing_list")
    found = fd.with_recovered_hs(F.array(F.lit("12345678")), text, doc_type)
    return table(spark, sf, "part").select("p_partkey", F.array_join(clean["kept"], ",").alias("kept"), F.array_join(clean["dropped"], ",").alias("dropped"), F.array_join(found, ",").alias("recovered"), F.array_join(fd.recover_containers(text), ",").alias("containers"))


CLIENT_TEXTS = ("Договор: ООО «Ромашка %s» (далее по тексту Клиент)", "Заказчик:\nАО \"Мир %s\", адрес", "клиент - ИП %s\nтел. 1", "Заказчик не указан %s")
CLIENTS = ("ООО «Ромашка %s»", "АО \"Мир %s\"", "ИП %s", None)
LEGS = (" Air", "road", "SEA ", "by train", None)


@query(f"SELECT c_custkey, replace({sql_pick('c_custkey', CLIENTS)}, '%s', 'К' || c_custkey) AS client, {sql_pick('c_custkey', ('air', 'road', 'sea', None, None))} AS leg FROM customer")
def forwarding_order(spark, sf):
    k = F.col("c_custkey")
    text = F.replace(pick(k, CLIENT_TEXTS), F.lit("%s"), F.concat(F.lit("К"), k))
    return table(spark, sf, "customer").select("c_custkey", fd.forwarding_client(text).alias("client"), fd.forwarding_leg(pick(k, LEGS)).alias("leg"))


# ---- records ----


def _customers(spark, sf):
    k = F.col("c_custkey")
    inn = _inn(k)
    wrong = F.concat(F.substring(inn, 1, 9), (F.substring(inn, 10, 1).cast("int") + 1) % 10)
    given = F.when(k % 4 == 0, F.concat(F.substring(inn, 1, 2), F.lit(" "), F.substring(inn, 3, 8))).when(k % 4 == 1, wrong).when(k % 4 == 2, F.lpad(k.cast("string"), 13, "1"))
    rec = record(seller__inn=given, seller__ogrn=F.when(k % 3 == 0, F.lit("old")), buyer__inn=inn, number=k)
    return table(spark, sf, "customer").select("c_custkey", rec.alias("r"))


@query(f"""SELECT k AS c_custkey, CASE k % 4 WHEN 0 THEN inn[1:2] || ' ' || inn[3:10] WHEN 1 THEN inn[1:9] || (inn[10]::INT + 1) % 10 END AS inn, CASE WHEN k % 3 = 0 THEN 'old' WHEN k % 4 = 2 THEN lpad(k::VARCHAR, 13, '1') END AS ogrn, CASE WHEN k % 4 = 2 THEN 'seller' ELSE '' END AS moved FROM {INN_SQL} t""")
def relocate_ogrn(spark, sf):
    new = rc.relocate_ogrn(F.col("r"))
    return _customers(spark, sf).select("c_custkey", rc.path(new, "seller.inn").alias("inn"), rc.path(new, "seller.ogrn").alias("ogrn"), F.array_join(rc.relocated(F.col("r")), ",").alias("moved"))


@query(f"""SELECT k AS c_custkey, CASE k % 4 WHEN 0 THEN inn END AS seller, inn AS buyer, CASE k % 4 WHEN 1 THEN 'seller.inn=' || inn[1:9] || (inn[10]::INT + 1) % 10 WHEN 2 THEN 'seller.inn=' || lpad(k::VARCHAR, 13, '1') ELSE '' END AS dropped FROM {INN_SQL} t""")
def sanitize_inns(spark, sf):
    new, gone = rc.sanitize_inns(F.col("r")), rc.dropped_inns(F.col("r"))
    return _customers(spark, sf).select("c_custkey", rc.path(new, "seller.inn").alias("seller"), rc.path(new, "buyer.inn").alias("buyer"), F.array_join(F.transform(F.map_entries(gone), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("dropped"))


@query(f"""SELECT k AS c_custkey, round(CASE k % 4 WHEN 0 THEN 0.95 WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 0.3 ELSE 0.35 END WHEN 2 THEN CASE WHEN k % 3 = 0 THEN 0.3 ELSE 0.3 END ELSE CASE WHEN k % 3 = 0 THEN 0.6 END END, 6)::DOUBLE AS seller, CASE WHEN k % 3 = 0 THEN 0.99 ELSE 0.95 END::DOUBLE AS buyer, 0.7::DOUBLE AS number, CASE WHEN k % 5 = 0 THEN 0.9 ELSE 0.4 END::DOUBLE AS plate FROM {INN_SQL} t""")
def field_confidence_map(spark, sf):
    k = F.col("c_custkey")
    given = F.map_from_entries(F.filter(F.array(F.struct(F.lit("seller.inn").alias("key"), F.when(k % 3 == 0, 0.6).alias("value")), F.struct(F.lit("buyer.inn").alias("key"), F.when(k % 3 == 0, 0.99).alias("value")), F.struct(F.lit("vehicle.plate").alias("key"), F.lit(0.5).alias("value")), F.struct(F.lit("odd").alias("key"), F.lit(7.0).alias("value"))), lambda e: e["value"].isNotNull()))
    rec = F.map_concat("r", record(vehicle__plate=F.when(k % 5 == 0, F.lit("A123BC77")).otherwise(F.lit("nothing"))))
    c = _customers(spark, sf).select("c_custkey", rc.field_confidence(rec, given).alias("m"))
    return c.select("c_custkey", *[F.try_element_at("m", F.lit(p)).alias(n) for n, p in (("seller", "seller.inn"), ("buyer", "buyer.inn"), ("number", "number"), ("plate", "vehicle.plate"))])


@query("""SELECT o_orderkey, o_orderkey % 3 <> 2 AND o_orderkey % 4 = 0 AND o_orderkey % 5 = 0 AS suspect, CASE WHEN o_orderkey % 3 <> 2 AND o_orderkey % 4 = 0 AND o_orderkey % 5 = 0 THEN NULL ELSE 'RUB' END AS currency FROM orders""")
def letter_guard(spark, sf):
    k = F.col("o_orderkey")
    suspect = rc.suspect_letter(pick(k, ("invoice", "tax_invoice", "UPD")), k % 4, F.when(k % 5 == 0, pick(k, ("0", " ", None, "0,0"))).otherwise("12"), F.lit("0"))
    return table(spark, sf, "orders").select("o_orderkey", suspect.alias("suspect"), F.when(~suspect, "RUB").alias("currency"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'country,doc_kind,present' WHEN c_custkey % 3 = 1 THEN 'doc_kind,present' ELSE 'country,surname' END AS keys FROM customer""")
def id_allow_list(spark, sf):
    k = F.col("c_custkey")
    rec = F.when(k % 3 == 0, record(surname=F.lit("x"), country=F.lit("LVA"))).when(k % 3 == 1, record(surname=F.lit("x"), doc_kind=F.lit("id"))).otherwise(record(surname=F.lit("x"), country=F.lit("LVA")))
    out = rc.id_allow_list(rec, F.when(k % 3 == 0, "passport").when(k % 3 == 2, "invoice"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.array_sort(F.map_keys(out)), ",").alias("keys"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '[ID PAGE]' ELSE 'Паспорт [REDACTED]' END || '|code [REDACTED]' AS pages, CASE WHEN c_custkey % 2 = 0 THEN 'country,doc_kind,present' ELSE 'doc_kind,present' END AS keys FROM customer""")
def mask_id_pages(spark, sf):
    k = F.col("c_custkey")
    number = F.lpad((k % 1000000).cast("string"), 6, "3")
    one = F.when(k % 2 == 0, F.concat(F.lit("P<LVA"), F.lit("DOE<<JOHN"))).otherwise(F.concat(F.lit("Паспорт 12 34 № "), number))
    pages = F.array(F.struct(one.alias("text"), F.when(k % 2 == 0, "passport").alias("type")), F.struct(F.concat(F.lit("code "), number, F.lit("-12345")).alias("text"), F.lit("invoice").alias("type")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(rc.mask_id_pages(pages), "|").alias("pages"), F.array_join(F.array_sort(F.map_keys(rc.id_segment(one))), ",").alias("keys"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'i1' WHEN o_orderkey % 3 = 1 THEN 's1' END AS first, 2 + (o_orderkey % 2)::INT AS business FROM orders""")
def lift_legacy_items(spark, sf):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("array<string>")
    items = rc.lift_items(F.when(k % 3 == 0, F.array(F.lit("i1"))).otherwise(none), {"positions": F.expr("CAST(array() AS array<string>)"), "services": F.when(k % 3 == 1, F.array(F.lit("s1"))).otherwise(none), "goods": none})
    rec = record(number=k, seller__inn=F.lit("1"), seller__name=F.lit("x"), _meta=F.lit("y"), note=F.lit(""), total=F.when(k % 2 == 1, F.lit("5")))
    return table(spark, sf, "orders").select("o_orderkey", F.get(items, F.lit(0)).alias("first"), rc.business_fields(rec).alias("business"))


@query("""SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderkey % 2 = 0 THEN 'added:NULL>n' END, CASE WHEN o_orderkey % 3 = 0 THEN 'status:a>b' END) AS diff FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def audit_diff(spark, sf):
    k = F.col("o_orderkey")
    before, after = record(same=k, status=F.lit("a")), record(same=k, status=F.when(k % 3 == 0, "b").otherwise("a"), added=F.when(k % 2 == 0, F.lit("n")))
    t = table(spark, sf, "orders").select("o_orderkey", rc.audit_diff(before, after).alias("d")).where("d IS NOT NULL")
    null = lambda c: F.coalesce(c, F.lit("NULL"))
    return t.select("o_orderkey", F.array_join(F.array_sort(F.transform(F.map_entries("d"), lambda e: F.concat(e["key"], F.lit(":"), null(e["value"]["from"]), F.lit(">"), null(e["value"]["to"])))), ";").alias("diff"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN 'Transportation' END AS hint FROM orders""")
def transport_hint(spark, sf):
    k = F.col("o_orderkey")
    rec = record(order_ref=F.when(k % 5 == 0, k), vehicle__plate=F.when(k % 5 == 1, F.lit("A1")), route_from=F.when(k % 5 != 4, F.lit("Riga")), route_to=F.when(k % 5 == 2, F.lit("Minsk")).otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", rc.transport_hint(rec).alias("hint"))


# ---- privacy ----


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '[REDACTED: key=api_key]' WHEN 1 THEN '[REDACTED: secret]' ELSE 'plain ' || c_custkey END AS value, 'v' || c_custkey AS other FROM customer""")
def scrub_metadata(spark, sf):
    k = F.col("c_custkey")
    rec = record(auth__api_key=F.when(k % 4 == 0, k), note=F.when(k % 4 == 1, F.concat(F.lit("AKIA"), F.lpad(k.cast("string"), 16, "0"))).when(k % 4 > 1, F.concat(F.lit("plain "), k)), other=F.concat(F.lit("v"), k))
    m = rc.scrub_metadata(rec)
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(rc.path(m, "auth.api_key"), rc.path(m, "note")).alias("value"), rc.path(m, "other").alias("other"))


PII_TEXTS = ("паспорт 12 34 № %s", "вод. удостоверение: 12 34 %s.", "P<LVADOE<<JOHN", "AB%s<1LVA%s1M%s1<<<", "passport: AB %s!", "x %s-12345 y", "asmens kodas: %s.", "тел. +7 (912) 345-67-89", "mail a.b@c.org, ok")
PII_CLEAN = ("паспорт [REDACTED]", "вод. удост [REDACTED].", "[REDACTED]", "[REDACTED]", "passport: AB [REDACTED]!", "x [REDACTED] y", "asmens kodas: [REDACTED].", "тел. [REDACTED]", "mail [REDACTED], ok")


@query(f"SELECT c_custkey, {sql_pick('c_custkey', PII_CLEAN)} AS clean, '[REDACTED]' AS driver FROM customer")
def redact_record(spark, sf):
    k = F.col("c_custkey")
    rec = record(note=F.replace(pick(k, PII_TEXTS), F.lit("%s"), F.lpad((k % 1000000).cast("string"), 6, "4")), vehicle__driver=k)
    m = rc.redact_fields(rec)
    return table(spark, sf, "customer").select("c_custkey", rc.path(m, "note").alias("clean"), rc.path(m, "vehicle.driver").alias("driver"))


# ---- validation and quality ----

SPECS = ("inn_checksum:inn", "kpp_format:kpp", "vehicle_plate:plate", "country_code:country", "date_range:day,2010-01-01,2030-01-01", "weight_nett_le_gross:nett,gross", "vat_consistency", "money_sanity:total", "parties_differ:inn,kpp")


@query(f"""SELECT k AS c_custkey, concat_ws(';', CASE WHEN k % 2 = 0 THEN 'inn has a wrong check digit' END, CASE WHEN k % 3 = 0 THEN 'kpp malformed' END, CASE WHEN k % 5 = 0 THEN 'plate malformed' END, CASE WHEN k % 7 = 0 THEN 'country malformed' END,
 CASE k % 4 WHEN 0 THEN 'day doesn''t exist' WHEN 1 THEN 'day out of range' WHEN 2 THEN 'day malformed' END, CASE WHEN k % 6 = 0 THEN 'nett exceeds gross' END, CASE WHEN k % 8 = 0 THEN 'vat doesn''t fit vat_rate' END, CASE WHEN k % 9 = 0 THEN 'total out of range' END) AS issues FROM {INN_SQL} t""")
def validator_registry(spark, sf):
    k, inn = F.col("c_custkey"), _inn(F.col("c_custkey"))
    wrong = F.concat(F.substring(inn, 1, 9), (F.substring(inn, 10, 1).cast("int") + 1) % 10)
    t = table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 2 == 0, wrong).otherwise(inn).alias("inn"), F.when(k % 3 == 0, F.lit("12")).otherwise(F.lit("7701AB001")).alias("kpp"), F.when(k % 5 == 0, F.lit("Z")).when(k % 5 == 1, F.lit("а123вс 77")).alias("plate"),
        F.when(k % 7 == 0, F.lit("Lv")).otherwise("LV").alias("country"), pick(k, ("2026-02-30", "2009-12-31", "1.2.2020", "2024-02-29")).alias("day"), F.when(k % 6 == 0, 5.0).alias("nett"), F.lit(4.0).alias("gross"),
        F.when(k % 9 == 0, -1.0).otherwise(120.0).alias("total"), F.when(k % 9 == 0, F.lit(None)).when(k % 8 == 0, 30.0).otherwise(20.0).alias("vat"), F.lit(20).alias("vat_rate"),
    )
    t = t.withColumn("vat", F.when((k % 8 == 0) & (k % 9 == 0), 30.0).otherwise(F.col("vat")))
    return t.select("c_custkey", F.array_join(ck.issues(SPECS), ";").alias("issues"))


LINE_SPECS = ("items_total_sum:header,0.02", "items_vat_rates", "items_unit_known", "items_line_consistency", "items_hs_code_format")


@query("""WITH l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS line, l_linenumber, l_quantity AS qty, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 2 ELSE l_quantity * 2 + 1 END AS total FROM lineitem),
 s AS (SELECT doc, sum(total) AS summed, array_to_string((list(line::VARCHAR ORDER BY line) FILTER (l_linenumber = 3))[1:10], ',') AS rates, array_to_string((list(line::VARCHAR ORDER BY line) FILTER (l_linenumber = 4))[1:10], ',') AS units, array_to_string((list(line::VARCHAR ORDER BY line) FILTER (l_linenumber % 2 > 0))[1:10], ',') AS odd, array_to_string((list(line::VARCHAR ORDER BY line) FILTER (l_linenumber = 5))[1:10], ',') AS hs FROM l GROUP BY 1)
 SELECT doc, concat_ws(';', CASE WHEN doc % 2 = 0 THEN 'items don''t add up to header' END, 'vat_rate in lines ' || rates, 'unit in lines ' || units, 'total in lines ' || odd, 'hs_code in lines ' || hs) AS issues FROM s""")
def validate_items(spark, sf):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    total = F.when(n % 2 == 0, q * 2).otherwise(q * 2 + 1)
    item = F.struct(n.alias("line"), q.cast("double").alias("qty"), F.lit(2.0).alias("price"), total.cast("double").alias("total"), F.lit(None).cast("double").alias("total_with_vat"), F.lit(None).cast("double").alias("total_without_vat"), F.when(n == 3, 18.0).otherwise(20.0).alias("vat_rate"), F.when(n == 4, "barrel").otherwise(" КГ ").alias("unit"), F.when(n == 5, "123").otherwise("8471 3000").alias("hs_code"))
    docs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum(total.cast("double")).alias("summed"))
    docs = docs.withColumn("header", F.col("summed") + F.when(F.col("doc") % 2 == 0, 1.0).otherwise(0.0))
    return docs.select("doc", F.array_join(ck.issues(LINE_SPECS), ";").alias("issues"))


@query(f"""SELECT k AS c_custkey, concat_ws(';', CASE WHEN k % 7 IN (0, 3, 5, 6) THEN 'seller_inn equals buyer_inn;total out of range' WHEN k % 7 = 1 THEN 'plate malformed' WHEN k % 7 = 2 THEN 'country malformed;nett exceeds gross' END,
 {sql_pick('k', (None, 'date out of range', "date doesn't exist", 'date malformed', None, 'date out of range'))}) AS issues FROM {INN_SQL} t""")
def issues_by_type(spark, sf):
    k, inn = F.col("c_custkey"), _inn(F.col("c_custkey"))
    date = pick(k, ("2024-02-29", "2009-12-31", "2023-02-29", "1.2.2024", None, "2999-01-01"))
    t = table(spark, sf, "customer").select("c_custkey", pick(k, ("invoice", "TTN", "CMR", "AKT", "letter", "factInvoice", "UPD")).alias("type"), inn.alias("seller_inn"), inn.alias("buyer_inn"), F.lit(-5.0).alias("total"), F.lit(None).cast("double").alias("vat"), F.lit(20).alias("vat_rate"), F.lit("x").alias("plate"), F.lit("x").alias("country"), F.lit(2).alias("nett"), F.lit(1).alias("gross"), date.alias("date"))
    return t.select("c_custkey", F.array_join(ck.issues_by_type(F.col("type"), ck.BY_TYPE), ";").alias("issues"))


BLEED = "Okay, let me look at this document step by step. "


@query("""WITH t AS (SELECT event_id AS id, event_id % 3 AS fields, event_id % 7 AS missing, event_id % 2 = 0 AS bleed, event_id % 5 = 0 AS cut, value / 1000 AS conf FROM events),
 f AS (SELECT id, fields, bleed, cut, fields > 0 AND conf >= 0.8 AND missing > 4.2 AS sparse FROM t)
 SELECT id, round(CASE WHEN fields = 0 THEN 1.5 ELSE 0 END + CASE WHEN sparse THEN 0.6 ELSE 0 END + CASE WHEN cut THEN 1 ELSE 0 END + CASE WHEN bleed THEN 1 ELSE 0 END, 6)::DOUBLE AS score, concat_ws(',', CASE WHEN fields = 0 THEN 'empty_extract' END, CASE WHEN sparse THEN 'confident_sparse' END, CASE WHEN cut THEN 'truncated_json' END, CASE WHEN bleed THEN 'reasoning_bleed' END) AS factors,
 fields = 0 OR cut OR bleed AS again FROM f""")
def quality_assessment(spark, sf):
    k = F.col("event_id")
    response = F.concat(F.when(k % 2 == 0, BLEED).otherwise(""), F.when(k % 5 == 0, '{"a": {').otherwise('{"a": 1}'))
    q = rc.quality(k % 3, F.lit(6), k % 7, F.col("value") / 1000, response, F.lit("plain words only " * 5))
    return table(spark, sf, "events").select(k.alias("id"), q.alias("q")).select("id", F.round("q.score", 6).alias("score"), F.array_join("q.factors", ",").alias("factors"), "q.again")


@query("""SELECT event_id AS id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 5 = 0 OR (event_id % 13 = 0 AND event_id % 4 > 0 AND event_id % 9 > 0) OR (event_id % 2 > 0 AND (event_id % 3 = 0 OR value / 1000 < 0.5)) THEN 'needs_review' ELSE 'done' END AS status FROM events""")
def status_decision(spark, sf):
    k = F.col("event_id")
    status = rc.decide_status(F.when(k % 5 == 0, 2).otherwise(0), k % 7 == 0, k % 13, F.when(k % 3 > 0, "invoice"), F.col("value") / 1000, k % 2 == 0, k % 11 == 0, skipped=k % 4 == 0, checked=k % 9 == 0)
    return table(spark, sf, "events").select(k.alias("id"), status.alias("status"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{"a": {"b": ' || turn || '}}' END AS salvaged, turn % 2 = 0 AS bleed FROM conversations""")
def salvage_json(spark, sf):
    k = F.col("turn")
    text = F.when(k % 3 == 0, F.concat(F.lit("so } is this: "), F.lit('{"a": {"b": '), k, F.lit("}} end"))).when(k % 3 == 1, F.lit("{broken: } x")).otherwise(F.lit("no braces"))
    return table(spark, sf, "conversations").select("conv_id", "turn", rc.salvage_json(F.when(k % 3 == 0, F.regexp_replace(text, "so } is", "so it is")).otherwise(text)).alias("salvaged"), rc.reasoning_bleed(F.concat(F.when(k % 2 == 0, F.lit(BLEED)).otherwise("ok"), F.lit("{}"))).alias("bleed"))


@query("""SELECT event_id, CASE WHEN event_id % 4 > 0 OR event_id % 6 > 0 THEN CASE WHEN event_id % 4 > 0 THEN event_id % 100 ELSE 0 END + CASE WHEN event_id % 6 > 0 THEN event_id % 50 ELSE 0 END END AS units FROM events""")
def token_units(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", rc.token_units(F.when(k % 4 > 0, k % 100), F.when(k % 6 > 0, k % 50)).alias("units"))


@query("""SELECT p_partkey, p_name || ' / ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '@12' END || ' @99' AS value FROM part""")
def expand_references(spark, sf):
    raw = F.concat(F.lit("Словарь повторов\n@1 = "), F.col("p_name"), F.lit("\n  @12 = "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("@12"), F.lit("\nend"))
    return table(spark, sf, "part").select("p_partkey", rc.expand_references(F.lit("@1 / @12 @99"), raw).alias("value"))


# ---- numbers ----

WEIGHTS = (("1,5 т", None), ("250 g", None), ("12.5", "kg"), ("3", "box"), ("2 000,25", ""))
MONEY_SIGNS = ("руб.", "₽", "usd", "US$", "Евро", "xyz", "??", "тенге")


@query(f"""SELECT p_partkey, {sql_pick('p_partkey', (1500.0, 0.25, 12.5, None, 2000.25))}::DOUBLE AS kg, {sql_pick('p_partkey', ('RUB', 'RUB', 'USD', 'USD', 'EUR', 'XYZ', None, 'KZT'))} AS currency FROM part""")
def weights_and_currencies(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", vl.weight_kg(pick(k, [w for w, _ in WEIGHTS]), pick(k, [u for _, u in WEIGHTS])).alias("kg"), vl.currency(pick(k, MONEY_SIGNS)).alias("currency"))


@query("""SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0 WHEN value > 1 THEN least(1, value / 100) ELSE greatest(0, value) END, 6)::DOUBLE AS ocr, round(CASE WHEN event_id % 3 = 0 THEN value / 1000 WHEN event_id % 3 = 1 THEN value / 1000 * 0.85 ELSE sqrt(value / 1000 * 0.5) END, 6)::DOUBLE AS combined FROM events""")
def confidences(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    ocr = tx.normalize_confidence(F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(v))
    both = tx.combine_confidence(v / 1000, F.when(k % 3 == 1, F.lit(0.0)).when(k % 3 == 2, F.lit(0.5)))
    return table(spark, sf, "events").select("event_id", tx.js_round(ocr, 6).alias("ocr"), tx.js_round(both, 6).alias("combined"))


@query("""WITH r AS (SELECT * FROM (VALUES ('p0', 'RUB', 'vendor', 2.0, 4.0), ('p1', 'USD', 'vendor', 0.1, NULL), ('p2', 'RUB', 'free', 9.0, 9.0)) v(pid, cur, basis, rin, rout)),
 e AS (SELECT event_id AS id, CASE WHEN user_id % 5 < 4 THEN 'p' || user_id % 5 END AS pid, event_id % 3000 AS p, event_id % 700 AS o, CASE WHEN event_id % 3 = 0 THEN event_id % 4 END AS pages FROM events),
 j AS (SELECT e.*, coalesce(cur, 'RUB') AS cur, coalesce(basis, 'vendor') AS basis, CASE WHEN cur IS NULL THEN 1.0 ELSE rin END AS rin, CASE WHEN cur IS NULL THEN 3.0 ELSE coalesce(rout, 3.0) END AS rout, cur IS NULL AS fb FROM e LEFT JOIN r USING (pid)),
 l AS (SELECT *, CASE WHEN p > 0 AND basis <> 'free' THEN p / 1000 * rin * CASE WHEN cur = 'USD' THEN 80 ELSE 1 END ELSE 0 END AS cin, CASE WHEN o > 0 AND basis <> 'free' THEN o / 1000 * rout * CASE WHEN cur = 'USD' THEN 80 ELSE 1 END ELSE 0 END AS cout, CASE WHEN pages > 0 THEN pages * 1.5 ELSE 0 END AS cocr FROM j)
 SELECT id, round(floor(cin * 100 + 0.5) / 100 + floor(cout * 100 + 0.5) / 100 + floor(cocr * 100 + 0.5) / 100, 2)::DOUBLE AS total, coalesce((p > 0 OR o > 0) AND fb, false) OR coalesce(pages = 0, false) OR coalesce(pages > 0, false) AS estimate FROM l""")
def cost_lines(spark, sf):
    rates = spark.createDataFrame([("p0", "RUB", "vendor", 2.0, 4.0, None, None), ("p1", "USD", "vendor", 0.1, None, None, None), ("p2", "RUB", "free", 9.0, 9.0, None, None)], costs.RATES)
    u, k = F.col("user_id"), F.col("event_id")
    jobs = table(spark, sf, "events").select(k.alias("id"), F.when(u % 5 < 4, F.concat(F.lit("p"), u % 5)).alias("model"), (k % 3000).alias("prompt"), (k % 700).alias("output"), F.lit(0).alias("unknown_calls"), F.when(k % 3 == 0, F.lit("cloud")).alias("ocr"), F.when(k % 3 == 0, k % 4).alias("pages"), F.lit(False).alias("tables"))
    return costs.breakdown(jobs, rates, usd=80.0).select("id", F.round("total", 2).alias("total"), "estimate")


INVOICE_SQL = f"""WITH i AS {INN_SQL}, o AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderdate AS d, i.inn, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN i ON i.k = o_custkey)
 SELECT k AS id, 'A-' || k AS number, strftime(d, '%Y-%m-%d') AS date, p AS total, CASE WHEN k % 5 <> 0 THEN round(floor(p * 20 + 0.5) / 100, 2) END AS vat, CASE WHEN k % 5 <> 0 THEN 20::DOUBLE END AS vat_rate, inn AS seller, CASE WHEN k % 3 = 0 THEN '7707083893' END AS buyer,
  CASE WHEN k % 2 = 0 THEN '1027700132' || lpad((k % 1000)::VARCHAR, 3, '0') END AS ogrn, CASE WHEN k % 4 > 0 THEN '044525' || lpad((k % 1000)::VARCHAR, 3, '0') END AS bik, CASE WHEN k % 4 > 0 THEN lpad(k::VARCHAR, 20, '4') END AS account, CASE WHEN k % 4 = 1 THEN lpad(k::VARCHAR, 20, '3') END AS corr_account,
  CASE WHEN k % 3 = 1 THEN 'IMP-2026-' || lpad((k % 1000)::VARCHAR, 3, '0') END AS order_ref, CASE WHEN k % 3 = 1 THEN 'А' || lpad((k % 1000)::VARCHAR, 3, '0') || 'ВС77' END AS plate, CASE WHEN k % 3 = 1 THEN 'Volvo FH' END AS model, CASE WHEN k % 3 = 1 AND k % 2 = 0 THEN 'Goldhofer STZ-1' END AS trailer,
  CASE WHEN k % 3 = 1 THEN (k % 9 + 2)::DOUBLE END AS axles, CASE WHEN k % 6 = 1 THEN 'Рига' END AS route_from, CASE WHEN k % 6 = 1 THEN 'Нижний Новгород' END AS route_to, CASE WHEN k % 7 = 0 THEN '77-2026-' || (k + 100) END AS permit_no, CASE WHEN k % 7 = 0 THEN 'ГИБДД' END AS issued_by, CASE WHEN k % 7 = 0 THEN '2026-12-03' END AS valid_to,
  CASE WHEN k % 5 = 1 THEN '2026-02-0' || (k % 9 + 1) END AS due_date, ['cash', 'prepayment', NULL, 'card'][k % 4 + 1] AS payment, CASE WHEN k % 9 = 0 THEN 'rail' WHEN k % 11 = 0 THEN 'sea' WHEN k % 11 = 1 THEN 'auto' END AS leg,
  CASE WHEN k % 8 = 1 THEN (k % 900)::DOUBLE END AS weight, CASE WHEN k % 8 = 1 THEN 10.5 + 3.8 + 4.0 END AS size, CASE WHEN k % 8 = 2 THEN 'Габариты груза ' || k END AS raw_size, CASE WHEN k % 8 = 1 THEN true END AS oversized, CASE WHEN k % 8 = 1 THEN name END AS cargo, CASE WHEN k % 9 = 0 THEN true END AS escort, CASE WHEN k % 9 = 0 THEN 'патруль ГИБДД' END AS escort_type FROM o"""


@query(INVOICE_SQL)
def invoice_fields(spark, sf):
    """Invoices written from orders, each with some of the sections. (The mark of rail also stands in the word for escort.)"""
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    k = F.col("o_orderkey")
    body = F.lpad(F.col("o_custkey").cast("string"), 9, "7")
    inn = F.concat(body, (sum((F.substring(body, i + 1, 1).cast("int") * w for i, w in enumerate(vl.INN_10)), F.lit(0)) % 11 % 10).cast("string"))
    three = F.lpad((k % 1000).cast("string"), 3, "0")
    line = lambda on, *parts: F.when(on, F.concat(F.lit("\n"), *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    money = lambda x: F.regexp_replace(F.translate(F.format_string("%.2f", x), ".", ","), r"([0-9])(?=(?:[0-9]{3})+,)", "$1 ")
    vat = F.floor(F.col("o_totalprice") * 20 + 0.5) / 100
    text = F.concat_ws(
        "", F.concat(F.lit("СЧЁТ на оплату No A-"), k.cast("string"), F.lit(" от "), F.date_format("o_orderdate", "dd.MM.yyyy")), line(F.lit(True), "Поставщик ИНН ", inn), line(k % 3 == 0, "Заказчик ИНН: 7707083893"), line(k % 2 == 0, "ОГРН 1027700132", three),
        line(k % 4 > 0, "БИК 044525", three, ", р/с ", F.lpad(k.cast("string"), 20, "4")), line(k % 4 == 1, "к/с № ", F.lpad(k.cast("string"), 20, "3")), line(k % 5 != 0, "НДС 20%: ", money(vat)), line(F.lit(True), "Итого к оплате: ", money(F.col("o_totalprice")), " руб"),
        line(k % 3 == 1, "По заявке клиента IMP-2026-", three, ", гос. номер А", three, "ВС77, Volvo FH, ", (k % 9 + 2).cast("string"), "-осный"), line((k % 3 == 1) & (k % 2 == 0), "полуприцеп: Goldhofer STZ-1"), line(k % 6 == 1, "Маршрут: г. Рига → г. Нижний Новгород\n."),
        line(k % 7 == 0, "Спецразрешение № 77-2026-", (k + 100).cast("string"), ", действует до 03.12.2026, x_ГИБДД"), line(k % 5 == 1, "Срок оплаты: ", (k % 9 + 1).cast("string"), ".02.2026"), line(k % 4 == 0, "cash"), line(k % 4 == 1, "prepay"), line(k % 4 == 2, "наличными"), line(k % 4 == 3, "card"),
        line(k % 11 == 0, "by sea"), line(k % 11 == 1, "тягач"), line(k % 8 == 1, "Груз: ", F.col("c_name"), "\n", (k % 900).cast("string"), " кгx, 10,5 x 3.8 × 4 м, негабаритный"), line(k % 8 == 2, "Габариты груза ", k.cast("string")), line(k % 9 == 0, "сопровождение: патруль ГИБДД"),
    )
    x = o.select(k.alias("id"), inv.invoice(text).alias("x"))
    cargo = "x.transport.cargo"
    size = F.col(f"{cargo}.dimensions.length_m") + F.col(f"{cargo}.dimensions.width_m") + F.col(f"{cargo}.dimensions.height_m")
    return x.select(
        "id", "x.number", "x.date", "x.total", "x.vat", F.col("x.vat_rate").cast("double").alias("vat_rate"), F.col("x.seller.inn").alias("seller"), F.col("x.buyer.inn").alias("buyer"), "x.seller.ogrn", "x.seller.bik", "x.seller.account", "x.seller.corr_account", "x.order_ref", "x.vehicle.plate", "x.vehicle.model", "x.vehicle.trailer", F.col("x.vehicle.axles").cast("double").alias("axles"),
        "x.route_from", "x.route_to", "x.permit_no", F.col("x.transport.permit.issued_by"), F.col("x.transport.permit.valid_to"), "x.due_date", F.col("x.payment_method").alias("payment"), F.col("x.transport.route.leg_kind").alias("leg"), F.col(f"{cargo}.weight_kg").alias("weight"), size.alias("size"),
        F.col(f"{cargo}.dimensions_raw").alias("raw_size"), F.col(f"{cargo}.oversized"), F.col(f"{cargo}.description").alias("cargo"), F.col("x.transport.escort.required").alias("escort"), F.col("x.transport.escort.type").alias("escort_type"),
    )
