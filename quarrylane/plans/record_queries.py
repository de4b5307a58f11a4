"""Records as JSON trees made of orders, their customers and lines: match signals, recovered numbers, model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, canonical, recover, signals, trees
from ..functions.values import INN_10
from ..operators.layout import spread
from ..sources.views import table
from .extract_queries import INN_SQL, pick, sql_pick
from .queries import query

TYPES = (
    "bill_of_lading", "TTN", "transport_invoice", "CMR", "invoice", "packing_list", "commercial_invoice", "wire_transfer_application", "payment_order", "customs_declaration", "weighing_act", "AKT", "factInvoice",
    "UPD", "proforma_invoice", "contract", None,
)


def _list(values: str | list[str]) -> str:
    return ", ".join(f"'{v}'" for v in (values.split() if isinstance(values, str) else values))


def with_lines(spark, sf, *customer: str, lines: Column) -> DataFrame:
    """Orders with columns of their customers and ``l``, an aggregate of their lines. Lines are dealt out by order once, and
    orders go to them: what is read from the rows afterwards runs in as many tasks, not in those that read row groups."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), *customer)
    own = spread(table(spark, sf, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(lines.alias("l"))
    return own.join(table(spark, sf, "orders").join(c, "o_custkey").hint("merge"), "o_orderkey")


def order_records(spark, sf) -> DataFrame:
    """id, type, record: an order with its customer, supplier names and lines as one JSON text."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    k, name = F.col("o_orderkey"), F.col("c_name")
    number = lambda x: F.concat(F.lit("MSKU"), F.lpad(x["l_partkey"].cast("string"), 7, "0"))
    who = lambda mark: F.struct(F.concat(F.lit(mark), name).alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("inn"), F.lit(" ").alias("kpp"))
    containers = F.transform("l", lambda x: F.struct(
        F.when(x["l_returnflag"] != "R", F.concat(number(x), F.lit(" 40HC"))).alias("number"), F.when(x["l_returnflag"] == "R", F.lower(number(x))).alias("container_number"),
        F.when(x["l_linenumber"] > 1, x["l_quantity"]).alias("gross_weight"), F.when(x["l_linenumber"] == 3, F.format_string("%.2f", x["l_extendedprice"])).alias("volume_m3"),
    ))
    items = F.transform("l", lambda x: F.struct(F.concat(F.lit(" PO-"), x["l_partkey"].cast("string")).alias("order_ref")))
    record = F.struct(
        F.concat(F.lit("N-"), k.cast("string")).alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("2026-01-02").alias("shipped_on_board"),
        *[who(m).alias(f) for f, m in (("seller", "S "), ("shipper", "H "), ("consignee", "N "), ("notify_party", "Y "), ("sender", "F "), ("recipient", "T "), ("carrier", "C "), ("forwarder", "W "), ("payer", "P "), ("payee", "E "), ("party_b", "B "))],
        F.when(k % 3 == 0, who("U ")).alias("buyer"), F.when(k % 3 == 1, who("X ")).alias("exporter"), F.when(k % 3 == 1, who("R ")).alias("consignor"), who("V ").alias("executor"), F.concat(F.lit("Z "), name).alias("beneficiary_name"),
        F.when(k % 3 != 2, F.col("o_totalprice")).alias("total"), (F.col("o_totalprice") + 1).alias("total_with_vat"), (F.col("o_totalprice") + 2).alias("amount"), (F.col("o_totalprice") + 3).alias("total_value"),
        F.when(k % 5 != 0, "USD").alias("currency"), F.array("o_orderpriority", F.lit(" "), F.col("o_orderpriority")).alias("order_refs"), items.alias("items"), containers.alias("containers"),
        F.struct(F.when(k % 4 != 0, F.concat(F.lit("A"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("BC77"))).alias("plate"), F.lit("T1").alias("trailer_plate"), F.when(k % 2 == 0, "T2").alias("trailer")).alias("vehicle"),
        pick(k, ("Master", "hbl", "SWB", None)).alias("bl_type"), F.concat(F.lit("M"), k.cast("string")).alias("master_bl_number"), pick(k, (None, "Telex", "odd")).alias("release_type"), (k % 3).alias("number_of_original_bls"),
        F.concat(F.lit("D-"), k.cast("string")).alias("declaration_number"), pick(k, (None, None, "DRAFT", "Proforma v2", "other")).alias("document_stage"),
        F.create_map(F.lit("number"), F.lit(0.5), F.lit("seller.inn"), (k % 10) / 10, F.lit("total_with_vat"), F.lit(0.75)).alias("_field_confidence"),
    )
    return with_lines(spark, sf, "c_name", "c_mktsegment", lines=F.array_sort(F.collect_list(line))).select(k.alias("id"), pick(k, TYPES).alias("type"), F.to_json(record).alias("record"))


SIGNALS_SQL = f"""WITH l AS (SELECT l_orderkey AS k, list({{'n': l_linenumber, 'p': l_partkey, 'q': l_quantity, 'e': l_extendedprice, 's': l_shipdate, 'f': l_returnflag}} ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) AS l FROM lineitem GROUP BY 1),
 d AS (SELECT o_orderkey AS k, {sql_pick("o_orderkey", TYPES)} AS t0, o_totalprice AS p, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS pri, c_name AS c, l FROM orders JOIN customer ON c_custkey = o_custkey JOIN l ON l.k = o_orderkey),
 t AS (SELECT *, coalesce(map {{'TTN': 'ttn', 'UPD': 'upd', 'CMR': 'cmr', 'AKT': 'services_act', 'factInvoice': 'tax_invoice'}}[t0], t0) AS t,
  list_transform(l, lambda x: 'MSKU' || lpad(x.p::VARCHAR, 7, '0')) AS nums FROM d),
 u AS (SELECT *, coalesce(t IN ({_list(list(signals.CONTAINERS))}), false) AS boxed, coalesce(t IN ({_list(list(signals.INVOICES))}), false) AS inv, coalesce(t = 'bill_of_lading', false) AS bl,
  list_filter(l, lambda x, i: x.n > 1 AND list_position(list_transform(list_filter(l, lambda z: z.n > 1), lambda z: z.p), x.p) = len(list_filter(l[:i], lambda z: z.n > 1))) AS m FROM t),
 v AS (SELECT *, list_filter([
   {{'r': 'buyer', 'n': CASE WHEN t = 'packing_list' THEN 'N ' WHEN t = 'customs_declaration' THEN 'T ' WHEN k % 3 = 0 THEN 'U ' END}}, {{'r': 'carrier', 'n': CASE WHEN t IN ('ttn', 'transport_invoice', 'cmr') THEN 'C ' END}},
   {{'r': 'consignee', 'n': CASE WHEN t IN ('bill_of_lading', 'ttn', 'transport_invoice', 'cmr') THEN 'N ' END}}, {{'r': 'customer', 'n': CASE WHEN t = 'services_act' THEN 'B ' END}},
   {{'r': 'executor', 'n': CASE WHEN t = 'services_act' THEN 'V ' END}}, {{'r': 'forwarder', 'n': CASE WHEN t = 'transport_invoice' THEN 'W ' END}}, {{'r': 'notify_party', 'n': CASE WHEN bl THEN 'Y ' END}},
   {{'r': 'payee', 'n': CASE WHEN t = 'payment_order' THEN 'E ' WHEN t = 'wire_transfer_application' THEN 'Z ' END}}, {{'r': 'payer', 'n': CASE WHEN t = 'payment_order' THEN 'P ' WHEN t = 'wire_transfer_application' THEN 'F ' END}},
   {{'r': 'seller', 'n': CASE WHEN t = 'packing_list' AND k % 3 = 1 THEN 'X ' WHEN t = 'customs_declaration' THEN 'F ' ELSE 'S ' END}}, {{'r': 'shipper', 'n': CASE WHEN t IN ('bill_of_lading', 'ttn', 'transport_invoice') THEN 'H ' WHEN t = 'cmr' AND k % 3 = 1 THEN 'R ' WHEN t = 'cmr' THEN 'F ' END}}], lambda x: x.n IS NOT NULL) AS roles FROM u)
 SELECT k AS id, CASE WHEN t IN ('bill_of_lading', 'ttn', 'transport_invoice', 'cmr') THEN 'N-' || k WHEN t = 'customs_declaration' THEN 'D-' || k END AS own_number,
  CASE WHEN boxed THEN array_to_string(list_transform(list_filter(nums, lambda x, i: list_position(nums, x) = i), lambda x: x), ',') END AS containers, CASE WHEN boxed THEN len(m) ELSE 0 END AS n_details,
  CASE WHEN boxed AND len(m) > 0 THEN list_sum(list_transform(m, lambda x: x.q)) END AS gross, CASE WHEN boxed AND len(m) > 0 THEN round(list_sum(list_transform(m, lambda x: CASE WHEN x.n = 3 THEN x.e ELSE 0 END)), 2) END AS volume,
  pri || ',' || array_to_string(list_filter(list_transform(l, lambda x: 'PO-' || x.p), lambda x, i: list_position(list_transform(l, lambda z: 'PO-' || z.p), x) = i), ',') AS order_refs,
  array_to_string(list_transform(roles, lambda x: x.r || '=' || x.n || c), ';') AS parties,
  CASE WHEN t IN ('ttn', 'transport_invoice', 'cmr') OR inv THEN CASE WHEN k % 4 <> 0 THEN 'А' || lpad((k % 1000)::VARCHAR, 3, '0') || 'ВС77' ELSE '' END || '/' || CASE WHEN inv THEN CASE WHEN k % 2 = 0 THEN 'T2' ELSE '' END ELSE 'T1' END END AS vehicle,
  CASE WHEN t IN ('wire_transfer_application', 'payment_order') THEN p + 2 WHEN t = 'customs_declaration' THEN p + 3 WHEN k % 3 <> 2 THEN p ELSE p + 1 END AS amount, CASE WHEN k % 5 <> 0 THEN 'USD' END AS currency,
  CASE WHEN bl THEN 'document=' || day || ';shipped_on_board=2026-01-02' ELSE 'document=' || day END AS dates,
  CASE WHEN t = 'proforma_invoice' OR k % 5 = 3 THEN 'proforma' WHEN k % 5 = 2 THEN 'draft' ELSE 'final' END AS stage,
  CASE WHEN bl THEN concat_ws('|', ['Master', 'House', 'Sea Waybill', NULL][k % 4 + 1], CASE WHEN k % 4 <> 0 THEN 'M' || k END, CASE WHEN k % 3 = 1 THEN 'telex_release' END, k % 3) END AS lading,
  round(coalesce(k % 10 / 10.0, 0) + CASE WHEN t IN ('bill_of_lading', 'ttn', 'transport_invoice', 'cmr') THEN 0.5 ELSE 0 END + 0.75, 6) AS rated FROM v"""


@query(SIGNALS_SQL)
def match_signals(spark, sf):
    s = order_records(spark, sf).select("id", signals.match_signals(F.try_parse_json("record"), F.col("type")).alias("s"))
    pairs = lambda m, value: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), value(e["value"])))), ";")
    details = F.col("s.container_details")
    total = lambda f: F.aggregate(F.transform(details, lambda d: F.coalesce(d[f], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    vehicle = F.when(F.col("s.vehicle").isNotNull(), F.concat(F.coalesce("s.vehicle.plate", F.lit("")), F.lit("/"), F.coalesce("s.vehicle.trailer", F.lit(""))))
    lading = F.concat_ws("|", "s.bl_type", "s.master_bl_number", "s.release_type", F.col("s.number_of_original_bls").cast("string"))
    rated = F.aggregate(F.map_values("s._confidence"), F.lit(0.0), lambda a, x: a + x)
    return s.select(
        "id", F.coalesce("s.bl_number", "s.ttn_number", "s.cmr_number", F.get("s.declaration_numbers", F.lit(0))).alias("own_number"), F.array_join("s.containers", ",").alias("containers"), F.coalesce(F.array_size(details), F.lit(0)).cast("long").alias("n_details"),
        total("gross_weight_kg").alias("gross"), F.round(total("volume_m3"), 2).alias("volume"), F.array_join("s.order_refs", ",").alias("order_refs"), pairs("s.parties", lambda p: p["name"]).alias("parties"), vehicle.alias("vehicle"),
        F.col("s.totals.amount").alias("amount"), F.col("s.totals.currency").alias("currency"), pairs("s.dates", lambda d: d).alias("dates"), F.col("s.document_stage").alias("stage"), F.nullif(lading, F.lit("")).alias("lading"), F.round(rated, 6).alias("rated"),
    )


def _inn(key: Column) -> Column:
    body = F.lpad(key.cast("string"), 9, "7")
    return F.concat(body, (sum((F.substring(body, i + 1, 1).cast("int") * w for i, w in enumerate(INN_10)), F.lit(0)) % 11 % 10).cast("string"))


LETTER_SQL = f"""WITH i AS {INN_SQL}, o AS (SELECT o_orderkey AS k, o_custkey, o_orderpriority AS pri, c.c_name AS name, i.inn, j.inn AS other FROM orders JOIN customer c ON c.c_custkey = o_custkey JOIN i ON i.k = o_custkey JOIN i j ON j.k = (o_custkey + 1) % (SELECT count(*) FROM customer)),
 x AS (SELECT k, inn, other, k % 6 = 1 AS bank_first, k % 6 = 2 AS wrong, k % 6 = 3 AS abroad, k % 6 = 4 AS own, k % 6 = 5 AS far FROM o)
 SELECT k AS id, CASE WHEN bank_first OR wrong OR abroad OR own OR far THEN NULL ELSE inn END AS seller, other AS buyer FROM x"""


@query(LETTER_SQL)
def recovered_inns(spark, sf):
    orders = table(spark, sf, "orders")
    o, c = orders, table(spark, sf, "customer").select("c_custkey", "c_name", _inn(F.col("c_custkey")).alias("inn"))
    n = F.broadcast(c.agg(F.count("*").alias("n")))  # one row
    o = o.crossJoin(n).withColumn("next", (F.col("o_custkey") + 1) % F.col("n"))
    o = o.join(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(c.select(F.col("c_custkey").alias("next"), F.col("inn").alias("other")), "next")
    o = spread(o.select("o_orderkey", "o_orderpriority", "c_name", "inn", "other"), "o_orderkey", rows_of=orders)
    k = F.col("o_orderkey")
    seller = F.concat(
        pick(k, ("Поставщик: ", "ПРОДАВЕЦ ", "Продавец:")), F.col("c_name"), F.when(k % 6 == 5, F.lpad(F.lit(""), 400, "-")).otherwise(""), F.when(k % 6 == 1, "\nБанк получателя: ПАО, ").otherwise(", "), pick(k, ("ИНН ", "ИНН/КПП: ", "инн № ", "ИНН:")),
        F.when(k % 6 == 2, F.concat(F.substring("inn", 1, 9), ((F.substring("inn", 10, 1).cast("int") + 1) % 10).cast("string"))).otherwise(F.col("inn")), F.lit(", КПП 997750001\nр/с 407 ИНН 7707083893\n"),
    )
    text = F.concat(F.lit("Счёт "), F.col("o_orderpriority"), F.lit("\n"), seller, F.lit("Покупатель: ООО «Т», ИНН "), F.col("other"), F.lit("\n"))
    record = F.map_from_entries(F.array_compact(F.array(F.when(k % 6 == 3, F.struct(F.lit("seller.country").alias("key"), F.lit("LV").alias("value"))), F.when(k % 6 == 4, F.struct(F.lit("seller.inn").alias("key"), F.col("other").alias("value"))))))
    found = o.select(k.alias("id"), recover.recovered_inns(record, text).alias("f"))
    return found.select("id", F.try_element_at("f", F.lit("seller.inn")).alias("seller"), F.try_element_at("f", F.lit("buyer.inn")).alias("buyer"))


ANSWERS_SQL = """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1)
 SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE 'N-' || o_orderkey END AS number, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_totalprice END AS total, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'RUB' ELSE 'USD' END AS currency,
  CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE c_name END AS buyer, CASE WHEN o_orderkey % 5 IN (0, 2) THEN 'B-' || o_custkey END AS account, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE n END AS n_items, CASE WHEN o_orderkey % 5 <> 4 THEN s END AS price,
  CASE o_orderkey % 5 WHEN 1 THEN 'currency,items,number,seller,total' WHEN 3 THEN 'buyer' WHEN 4 THEN '' END IS NOT NULL AS marked FROM orders JOIN customer ON c_custkey = o_custkey JOIN l ON k = o_orderkey"""


@query(ANSWERS_SQL)
def canonical_answers(spark, sf):
    """Five shapes of answers: loose fields in a section, an envelope with aliases, loose parties under other names, a
    section within a section, and no JSON."""
    o = with_lines(spark, sf, "c_name", lines=F.collect_list(F.struct(F.struct(F.col("l_extendedprice").alias("value"), F.lit("USD").alias("currency")).alias("price"), F.lit(None).alias("vat"))))
    k, price, name = F.col("o_orderkey"), F.col("o_totalprice"), F.col("c_name")
    number, account = F.concat(F.lit("N-"), k.cast("string")), F.concat(F.lit("B-"), F.col("o_custkey").cast("string"))
    money = F.struct(price.alias("amount"), F.lit("USD").alias("currency"))
    shapes = (
        F.struct(F.struct(number.alias("invoice_number"), price.alias("total_amount"), F.lit("").alias("date")).alias("invoice_details"), F.struct(account.alias("account_number"), F.lit("").alias("bic")).alias("payment_details"), F.struct(name.alias("name")).alias("customer"), F.col("l").alias("positions"), F.lit(0.5).alias("confidence")),
        F.struct(F.struct(number.alias("doc_number"), money.alias("total"), F.lit("RUB").alias("currency"), name.alias("buyer_name"), F.col("l").alias("items")).alias("extracted"), F.array(F.lit("x")).alias("issues")),
        F.struct(number.alias("number"), F.lit("ignored").alias("invoice_number"), money.alias("total"), F.struct(name.alias("name"), F.lit("1").alias("inn")).alias("party2"), F.struct(F.lit("").alias("name")).alias("buyer"), F.struct(account.alias("account_number")).alias("payment_details"), F.col("l").alias("goods")),
        F.struct(F.struct(F.struct(F.struct(number.alias("number")).alias("document"), money.alias("total"), F.struct(name.alias("name")).alias("buyer")).alias("invoice"), F.col("l").alias("line_items")).alias("extracted")),
    )
    text = F.lit("{no json")
    for i, shape in enumerate(shapes):
        text = F.when(k % 5 == i, F.to_json(shape)).otherwise(text)
    done = o.select(k.alias("id"), answers.canonical_answer(text).alias("a")).select("id", F.try_element_at("a", F.lit("extracted")).alias("x"))
    items = trees.members(trees.at(F.col("x"), "items"))
    paid = F.aggregate(F.transform(items, lambda i: trees.number(trees.at(i, "price"))), F.lit(0.0), lambda a, v: a + v)
    got = done.select("id", *[trees.text_at(F.col("x"), p).alias(n) for n, p in (("number", "number"), ("currency", "currency"), ("buyer", "buyer.name"), ("account", "seller.account"))], trees.number_at(F.col("x"), "total").alias("total"), F.size(items).cast("long").alias("n_items"), paid.alias("paid"))
    return got.select("id", "number", "total", "currency", "buyer", "account", "n_items", F.when(F.col("n_items") > 0, F.round("paid", 2)).alias("price"), (F.col("id") % 5).isin(1, 3, 4).alias("marked"))


def _joined(parts: list[str]) -> str:
    return "array_to_string(list_sort(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL) || more), ';')"


CITY_SQL = "CASE k % 6 WHEN 0 THEN 'Москва' WHEN 1 THEN name WHEN 2 THEN 'Рига' WHEN 3 THEN 'Минск' WHEN 4 THEN name ELSE 'Порт' END"
CANONICAL_SQL = f"""WITH i AS {INN_SQL}, l AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1),
 d AS (SELECT o_orderkey AS k, c_name AS name, inn, lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS n3, upper(c_mktsegment) AS seg, p FROM orders JOIN customer ON c_custkey = o_custkey JOIN i ON i.k = o_custkey JOIN l ON l.k = o_orderkey),
 e AS (SELECT *, flatten(list_transform(p, lambda x, j: ['containers.' || (j - 1) || '.number=MSKU' || x, 'items.' || (j - 1) || '.hs_code=' || (100000 + x)])) || list_transform(list_filter(list_transform(p, lambda x, j: CASE WHEN x % 2 = 0 THEN 'containers.' || (j - 1) || '.seal=S' || x END), lambda y: y IS NOT NULL), lambda y: y) AS more FROM d)
 SELECT k AS id, {_joined([
    *[f"CASE WHEN k % 8 = {i} THEN '{p}=' || inn END" for i, p in enumerate(("seller.inn", "buyer.inn", "shipper.inn", "consignee.inn", "carrier.inn", "payer.inn", "recipient.inn"))],
    "CASE WHEN k % 3 = 0 THEN 'vehicle.plate=А' || n3 || 'ВС77' END", "CASE WHEN k % 5 = 0 THEN 'vehicle.license_plate=О' || n3 || 'ХХ777' END",
    "CASE WHEN k % 2 = 0 THEN 'order_ref=' || seg END", "CASE WHEN k % 7 = 0 THEN 'permit_no=77-' || k END", "CASE WHEN k % 7 = 1 THEN 'seal_number=X' || k END",
    f"'route.from_canonical=' || {CITY_SQL}", f"'route.to_canonical=' || {CITY_SQL}",
    "CASE k % 4 WHEN 0 THEN 'currency=RUB' WHEN 1 THEN 'currency=EUR' WHEN 2 THEN 'currency=USD' END", "CASE WHEN k % 9 = 0 THEN 'declared_value.currency=CNY' END", "CASE WHEN k % 5 = 1 THEN 'hs_codes.0=' || (10000000 + k) END",
    "CASE WHEN k % 3 = 0 THEN 'vehicle.plate.script=latin' ELSE 'vehicle.plate.script=cyrillic' END", "CASE WHEN k % 5 = 0 THEN 'vehicle.license_plate.script=mixed' END", "CASE WHEN k % 7 = 2 THEN 'transport_identity.truck_plate.script=latin' END", "CASE WHEN k % 6 = 4 THEN 'driver.script=cyrillic' ELSE 'driver.script=latin' END",
 ])} AS canonical FROM e"""


@query(CANONICAL_SQL)
def canonical_fields(spark, sf):
    """Records with every field that has a canonical form, by turns."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", _inn(F.col("c_custkey")).alias("inn"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    k, name, inn = F.col("o_orderkey"), F.col("c_name"), F.col("inn")
    three, text = F.lpad((k % 1000).cast("string"), 3, "0"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    party = lambda i: F.struct(F.when(k % 8 == i, text("ИНН ", F.substring("inn", 1, 4), " ", F.substring("inn", 5, 6))).otherwise(F.lit("7700000000")).alias("inn"))
    part = lambda x: x["l_partkey"].cast("string")
    split = lambda n: F.regexp_replace(n.cast("string"), "^(.)", "$1 ")
    end = lambda e, load, port: (F.when(k % 6 == 0, "г. Москва, Россия").when(k % 6 == 1, "  ").alias(f"route_{e}"), F.when(k % 6 == 2, " Рига ").alias(f"{e}_city"), F.when(k % 6 == 4, name).alias(load), F.lit("Порт").alias(port))
    a, b = end("from", "place_of_loading", "port_of_loading"), end("to", "delivery_place", "port_of_discharge")
    record = F.struct(
        *[party(i).alias(p) for i, p in enumerate(("seller", "buyer", "shipper", "consignee", "carrier", "payer", "recipient"))],
        F.struct(F.when(k % 3 == 0, text("a", three, " bc-77")).otherwise(F.lit("нет")).alias("plate"), F.when(k % 5 == 0, text("O", three, "Хх 777")).alias("license_plate")).alias("vehicle"),
        F.when(k % 2 == 0, text(" ", F.lower("c_mktsegment"), " ")).alias("order_ref"), F.when(k % 7 == 0, text("77-", k.cast("string"), " ")).alias("permit_no"), F.when(k % 7 == 1, text("x", k.cast("string"))).alias("seal_number"),
        a[0], b[0],
        F.struct(F.struct(F.when(k % 6 == 1, text("город ", name, " (склад)")).alias("from"), F.when(k % 6 == 1, text("г ", name, ", склад")).alias("to")).alias("route")).alias("transport"),
        F.struct(a[1], b[1], F.when(k % 6 == 3, "Минск, 1").alias("from"), F.when(k % 6 == 3, "Минск (2)").alias("to")).alias("route"), a[2], a[3], b[2], b[3],
        F.transform("l", lambda x: F.struct(text(" msku", part(x)).alias("number"), F.when(x["l_partkey"] % 2 == 0, text("s", part(x))).alias("seal"))).alias("containers"),
        F.transform("l", lambda x: F.struct(F.when(x["l_partkey"] % 2 == 0, (x["l_partkey"] + 100000).cast("string")).otherwise(split(x["l_partkey"] + 100000)).alias("hs_code"))).alias("items"),
        pick(k, ("руб.", "€", "usd", "монет")).alias("currency"), F.struct(F.when(k % 9 == 0, "Юань").alias("currency")).alias("declared_value"), F.when(k % 5 == 1, F.array((k + 10000000).cast("string"), F.lit("12"))).alias("hs_codes"),
        F.struct(F.when(k % 7 == 2, "AB 12").alias("truck_plate"), F.lit("123").alias("trailer_plate")).alias("transport_identity"), F.struct(F.when(k % 6 == 4, "Иванов").alias("fio"), name.alias("fullName")).alias("driver"),
    )
    made = o.join(c, "o_custkey").join(lines, "o_orderkey").select(k.alias("id"), canonical.canonical_fields(F.try_parse_json(F.to_json(record))).alias("m"))
    return made.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("canonical"))
