"""One flat set of keys to match documents by, projected from records of every type by a table of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import slugs, trees
from .checks import plate
from .text import let

VERSION = "1.2"
# Types that share the invoice's rules, and types that name containers.
INVOICES = ("invoice", "tax_invoice", "upd", "proforma_invoice", "commercial_invoice")
CONTAINERS = ("bill_of_lading", "ttn", "cmr", "packing_list", "commercial_invoice", "weighing_act", "services_act")
TRANSPORT = ("ttn", "transport_invoice", "cmr")
# The party of each role, by types; None: of any type, if the type's own rule finds none. Paths in order.
PARTIES = (
    ("seller", (("packing_list",), ("exporter", "seller")), (("customs_declaration",), ("sender",)), (None, ("seller",))),
    ("buyer", (("packing_list",), ("consignee", "buyer")), (("customs_declaration",), ("recipient",)), (None, ("buyer",))),
    ("shipper", (("bill_of_lading", "ttn", "transport_invoice"), ("shipper",)), (("cmr",), ("consignor", "sender"))),
    ("consignee", (("bill_of_lading", "ttn", "transport_invoice"), ("consignee",)), (("cmr",), ("consignee", "recipient"))),
    ("notify_party", (("bill_of_lading",), ("notify_party",))),
    ("carrier", (TRANSPORT, ("carrier",))),
    ("forwarder", (("transport_invoice",), ("forwarder",))),
    ("payer", (("payment_order",), ("payer",))),
    ("payee", (("payment_order",), ("payee",))),
    ("executor", (("services_act",), ("party_a", "executor"))),
    ("customer", (("services_act",), ("party_b", "customer"))),
)
# Parties whose fields lie flat, by type and role.
FLAT_PARTIES = (("wire_transfer_application", "payer", ("sender_name", "sender.name"), ("sender_inn", "sender.inn")), ("wire_transfer_application", "payee", ("beneficiary_name", "beneficiary.name"), ()))
# The document's own number by type.
NUMBERS = (("bl_number", ("bill_of_lading",)), ("cmr_number", ("cmr",)), ("ttn_number", ("ttn", "transport_invoice")))
# Amount and tax, by types.
TOTALS = (
    (INVOICES, ("total", "total_with_vat"), ("vat",)), (("wire_transfer_application", "payment_order"), ("amount",), ()), (("customs_declaration",), ("total_value",), ()),
    (None, ("total", "total_with_vat", "total_amount"), ("vat",)),
)
# Where the trailer's plate stands, by types.
TRAILERS = ((("ttn",), ("vehicle.trailer_plate", "vehicle.trailer")), (("transport_invoice", "cmr"), ("vehicle.trailer_plate",)), (INVOICES, ("vehicle.trailer",)))
# Names of a container's weights, volume and packages.
CONTAINER_FIELDS = (
    ("gross_weight_kg", ("gross_weight_kg", "gross_weight", "weight_gross")), ("net_weight_kg", ("net_weight_kg", "net_weight", "weight_net")), ("volume_m3", ("volume_m3", "volume")),
    ("packages", ("packages", "places", "packages_count")),
)
# Whose confidence a key takes.
CONFIDENCE = (
    ("bl_number", ("number",)), ("ttn_number", ("number",)), ("cmr_number", ("number",)), ("declaration_numbers", ("declaration_number",)), ("containers", ("containers.0.number", "containers", "container_number")),
    ("vehicle.plate", ("vehicle.plate",)), ("totals.amount", ("total", "total_with_vat", "total_amount", "amount")), ("parties.seller", ("seller.inn",)), ("parties.buyer", ("buyer.inn",)),
    ("parties.shipper", ("shipper.inn",)), ("parties.consignee", ("consignee.inn",)), ("parties.carrier", ("carrier.inn",)), ("parties.executor", ("party_a.inn",)), ("parties.customer", ("party_b.inn",)),
    ("dates.document", ("date",)),
)
# The members that are read of every record, beside those of the tables above.
MEMBERS = (
    "number", "currency", "date", "shipped_on_board", "bl_type", "release_type", "master_bl_number", "declaration_number", "document_stage", "number_of_original_bls", "vehicle", "containers", "container_number", "container",
    "items", "positions", "order_refs", "order_ref", "order_number", "_field_confidence",
)
#: Keys of the result, between the version and the confidences.
KEYS = (
    "containers", "container_details", "bl_number", "cmr_number", "ttn_number", "declaration_numbers", "order_refs", "vehicle", "parties", "dates", "totals", "document_stage", "release_type", "bl_type",
    "master_bl_number", "number_of_original_bls",
)
#: Four letters and seven digits, with a blank between them at most.
CONTAINER_NUMBER = r"[A-Z]{4}[\s\p{Z}]?[0-9]{7}"


def _numbers_in(raw: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.upper(raw), F.lit(CONTAINER_NUMBER), F.lit(0)), lambda h: F.regexp_replace(h, r"[\s\p{Z}]", ""))


def _texts(values: Column) -> Column:
    """Texts without nulls, each once, null for none."""
    return let(F.array_distinct(F.array_compact(values)), lambda kept: F.when(F.size(kept) > 0, kept))


def _party(name: Column, inn: Column, kpp: Column) -> Column:
    return let(F.struct(name.alias("name"), inn.alias("inn"), kpp.alias("kpp")), lambda p: F.when(F.coalesce(p["name"], p["inn"], p["kpp"]).isNotNull(), p))


def _opened(tree: Column, doc_type: Column) -> Column:
    """The type's outside name and the record's members that the rules name, all found in one pass. What stands in them is
    read where a rule for the type asks for it."""
    paths = {p for _, *rules in PARTIES for _, ps in rules for p in ps} | {p for _, _, *both in FLAT_PARTIES for ps in both for p in ps} | {p for _, *both in TOTALS for ps in both for p in ps}
    paths |= {p for _, ps in TRAILERS for p in ps} | set(MEMBERS)
    return F.struct(slugs.outside(doc_type).alias("kind"), trees.members_of(tree, *sorted({p.partition(".")[0] for p in paths})).alias("of"))


def _with_boxes(x: Column) -> Column:
    return F.struct(x["kind"].alias("kind"), x["of"].alias("of"), F.when(x["kind"].isin(*CONTAINERS), _boxes(x["of"])).alias("boxes"))


def _at(record: Column, path: str) -> Column:
    top, _, inner = path.partition(".")
    return F.try_variant_get(record[top], trees.steps(inner), "variant") if inner else record[top]


def _first(record: Column, paths: tuple[str, ...], read) -> Column:
    """Of several paths the first that has a value: what it holds of the wanted kind, if that."""
    first, *more = [(trees.there(_at(record, p)), read(_at(record, p))) for p in paths]
    out = F.when(*first)
    for has, value in more:
        out = out.when(has, value)
    return out


def _typed(doc_type: Column, rules: tuple, body) -> Column:
    """``body(*rule)`` of the first rule for the type that gives something, in the order of the rules."""
    return F.coalesce(*[body(*rule) if types is None else F.when(doc_type.isin(*types), body(*rule)) for types, *rule in rules])


def _parties(record: Column, doc_type: Column) -> Column:
    """For each role what its rules for the type find, in their order; the first that holds a party counts."""
    as_it_is = lambda v: v
    blank = F.lit(None).cast("string")
    flat = {role: F.when(doc_type == kind, _party(_first(record, names, trees.text), _first(record, inns, trees.text) if inns else blank, blank)) for kind, role, names, inns in FLAT_PARTIES}
    none = F.lit(None).cast("struct<name:string,inn:string,kpp:string>")

    def found(role: str, rules: list) -> Column:
        of_rules = [_first(record, paths, as_it_is) if types is None else F.when(doc_type.isin(*types), _first(record, paths, as_it_is)) for types, paths in rules]
        return F.struct(F.lit(role).alias("key"), F.array_compact(F.array(*of_rules)).alias("found"), flat.get(role, none).alias("flat"))

    opened = lambda v: trees.members_of(v, "name", "inn", "kpp")
    read = lambda o: _party(*[trees.text(o[f]) for f in ("name", "inn", "kpp")])
    parties = lambda found: F.filter(F.transform(F.transform(found, opened), read), lambda p: p.isNotNull())
    roles = F.transform(F.array(*[found(role, rules) for role, *rules in PARTIES]), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.get(parties(e["found"]), F.lit(0)), e["flat"]).alias("value")))
    return _entries(F.filter(roles, lambda e: e["value"].isNotNull()))


def _mapped(values: dict[str, Column]) -> Column:
    """A map of the values that there are, null for none."""
    return _entries(F.filter(F.array(*[F.struct(F.lit(key).alias("key"), v.alias("value")) for key, v in values.items()]), lambda e: e["value"].isNotNull()))


def _entries(pairs: Column) -> Column:
    return let(pairs, lambda found: F.when(F.size(found) > 0, F.map_from_entries(found)))


def _boxes(record: Column) -> Column:
    """Entries of containers: the numbers that the first text of an entry lists, its own number, weights, volume, packages."""

    def texts(c: Column) -> Column:
        measures = [F.coalesce(*[trees.number(c[p]) for p in paths]).alias(f) for f, paths in CONTAINER_FIELDS]
        return F.struct(trees.text(c["number"]).alias("number"), trees.text(c["container_number"]).alias("other"), *measures)

    fields = [f for f, _ in CONTAINER_FIELDS]
    numbered = lambda t: F.struct(_numbers_in(F.coalesce(t["number"], t["other"])).alias("listed"), t["other"].alias("other"), *[t[f].alias(f) for f in fields])
    own = lambda t: F.coalesce(F.get(t["listed"], F.lit(0)), F.get(_numbers_in(t["other"]), F.lit(0)))
    entry = lambda t: F.struct(t["listed"].alias("listed"), own(t).alias("number"), *[t[f].alias(f) for f in fields])
    names = ("number", "container_number", *[p for _, paths in CONTAINER_FIELDS for p in paths])
    return F.transform(F.transform(F.transform(trees.listed(record["containers"], *names), texts), numbered), entry)


def _containers(record: Column, boxes: Column) -> Column:
    of_boxes = F.array_compact(F.transform(boxes, lambda e: e["listed"]))
    of_items = F.transform(trees.listed(record["items"], "container_no"), lambda i: trees.text(i["container_no"]))
    single = F.coalesce(trees.text(record["container_number"]), trees.text(_at(record, "container.number")))
    return _texts(F.flatten(F.concat(of_boxes, F.transform(F.array_compact(F.concat(of_items, F.array(single))), _numbers_in))))


def _container_details(boxes: Column) -> Column:
    """Weight, volume and packages of each container that has any; the first entry of a number counts."""
    fields = [f for f, _ in CONTAINER_FIELDS]
    measured = F.filter(boxes, lambda e: e["number"].isNotNull() & F.coalesce(*[e[f] for f in fields]).isNotNull())

    def once(all_: Column) -> Column:
        return let(F.transform(all_, lambda e: e["number"]), lambda numbers: F.filter(all_, lambda e, i: F.array_position(numbers, e["number"]) == i + 1))

    details = lambda kept: F.transform(kept, lambda e: F.struct(e["number"].alias("number"), *[e[f].alias(f) for f in fields]))
    return let(let(measured, once), lambda kept: F.when(F.size(kept) > 0, details(kept)))


def _order_refs(record: Column) -> Column:
    of_lines = F.transform(F.concat(*[trees.listed(record[f], "order_ref") for f in ("items", "positions")]), lambda i: trees.text(i["order_ref"]))
    own = F.array(*[trees.text(record[f]) for f in ("order_ref", "order_number")])
    return _texts(F.concat(F.transform(trees.members(record["order_refs"]), trees.text), own, of_lines))


def _vehicle(record: Column, doc_type: Column) -> Column:
    own = let(trees.text(_at(record, "vehicle.plate")), lambda raw: F.coalesce(plate(raw), raw))
    trailer = F.coalesce(*[F.when(doc_type.isin(*types), _first(record, paths, trees.text)) for types, paths in TRAILERS])
    found = let(F.struct(own.alias("plate"), trailer.alias("trailer")), lambda v: F.when(F.coalesce(v["plate"], v["trailer"]).isNotNull(), v))
    return F.when(doc_type.isin(*[t for types, _ in TRAILERS for t in types]), found)


def _totals(record: Column, doc_type: Column) -> Column:
    """The type's own totals as a whole if they hold anything, else the general ones."""

    def of(amounts: tuple, taxes: tuple) -> Column:
        tax = _first(record, taxes, trees.number) if taxes else F.lit(None).cast("double")
        money = F.struct(_first(record, amounts, trees.number).alias("amount"), trees.text(record["currency"]).alias("currency"), tax.alias("vat"))
        return let(money, lambda m: F.when(m["amount"].isNotNull() | m["currency"].isNotNull() | m["vat"].isNotNull(), m))

    return _typed(doc_type, TOTALS, of)


def _stage(record: Column, doc_type: Column) -> Column:
    def of(mark: Column) -> Column:
        out = F.when(doc_type == "proforma_invoice", "proforma")
        for word in ("draft", "proforma", "final"):
            out = out.when(F.contains(mark, F.lit(word)), word)
        return out.otherwise("final")

    return let(F.lower(trees.text(record["document_stage"])), of)


def _words(value: Column, table: tuple[tuple[str, str], ...]) -> Column:
    def of(low: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, name in table:
            out = out.when(low.rlike(pattern), name)
        return out

    return let(F.lower(value), of)


def match_signals(record: Column, doc_type: Column, confidence: Column | None = None) -> Column:
    """A struct of all keys, null where a document has no value; ``to_json`` of it holds those that it has. ``record``: a
    variant; ``confidence``: map from dotted path to number, of the record's ``_field_confidence`` if not given.

    General rules (seller, buyer, date, totals, order references) hold for every type; a type's own find more or take their
    place. schema_version and document_stage are always there."""
    def projected(x: Column) -> Column:
        kind, of = x["kind"], x["of"]
        text = lambda p: trees.text(of[p])
        is_bl = F.coalesce(kind == "bill_of_lading", F.lit(False))
        bl_type = F.when(is_bl, _words(text("bl_type"), (("master", "Master"), ("house|hbl", "House"), ("seaway|swb|waybill", "Sea Waybill"))))
        whole = F.when(is_bl, let(trees.number(of["number_of_original_bls"]), lambda n: F.when(n == F.floor(n), n.cast("long"))))
        said = lambda t: _words(t, (("telex", "telex_release"), ("surrender", "surrendered"), ("seaway|sea waybill", "seaway_waybill"), ("original", "original")))
        keys = {
            "containers": F.when(kind.isin(*CONTAINERS), _containers(of, x["boxes"])),
            "container_details": _container_details(x["boxes"]),
            **{name: F.when(kind.isin(*types), text("number")) for name, types in NUMBERS},
            "declaration_numbers": F.when(kind == "customs_declaration", _texts(F.array(text("declaration_number")))),
            "order_refs": _order_refs(of),
            "vehicle": _vehicle(of, kind),
            "parties": _parties(of, kind),
            "dates": _mapped({"document": text("date"), "shipped_on_board": F.when(is_bl, text("shipped_on_board"))}),
            "totals": _totals(of, kind),
            "document_stage": _stage(of, kind),
            "release_type": F.when(is_bl, let(text("release_type"), lambda t: F.when(t.isNotNull(), said(t)).when(whole >= 1, "original"))),
            "bl_type": bl_type,
            "master_bl_number": F.when(is_bl & ~F.coalesce(bl_type == "Master", F.lit(False)), text("master_bl_number")),
            "number_of_original_bls": whole,
        }
        confidence_of = given(of["_field_confidence"]) if confidence is None else confidence
        return F.struct(*[v.alias(k) for k, v in keys.items()], confidence_of.alias("given"))

    def given(value: Column) -> Column:
        return F.transform_values(F.map_filter(trees.entries(value), lambda _, v: trees.is_number(v)), lambda _, v: F.try_variant_get(v, "$", "double"))

    def with_confidence(s: Column) -> Column:
        def has(key: str) -> Column:
            top, _, inner = key.partition(".")
            return s[top].isNotNull() if not inner else F.try_element_at(s[top], F.lit(inner)).isNotNull() if top in ("parties", "dates") else s[top][inner].isNotNull()

        c = s["given"]
        rated = F.when(F.size(c) > 0, _mapped({key: F.when(has(key), F.coalesce(*[F.try_element_at(c, F.lit(p)) for p in paths])) for key, paths in CONFIDENCE}))
        return F.struct(F.lit(VERSION).alias("schema_version"), *[s[k].alias(k) for k in KEYS], rated.alias("_confidence"))

    return F.get(F.transform(F.transform(F.transform(F.array(_opened(record, doc_type)), _with_boxes), projected), with_confidence), F.lit(0))
