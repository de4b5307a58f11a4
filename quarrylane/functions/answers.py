"""Answers of language models, JSON of any shape, brought to one shape: envelope, paths, parties, items and money."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import trees
from .text import let

# Keys of the envelope, sections that hold header fields, and names of the array of items.
ENVELOPE = ("extracted", "confidence", "field_confidence", "issues", "document_type")
SECTIONS = ("invoice_details", "invoice", "document", "header", "doc")
ITEM_ARRAYS = ("positions", "services", "goods", "line_items")
# Other names of fields.
ALIASES = {
    "invoice_number": "number", "doc_number": "number", "document_number": "number", "invoice_date": "date", "doc_date": "date", "document_date": "date", "total_amount": "total", "amount_total": "total",
    "grand_total": "total", "total_sum": "total", "vat_amount": "vat", "vat_total": "vat", "tax_amount": "vat", "seller_inn": "seller.inn", "seller_name": "seller.name", "seller_kpp": "seller.kpp",
    "buyer_inn": "buyer.inn", "buyer_name": "buyer.name", "buyer_kpp": "buyer.kpp",
}
# Other names of the parties, and where payment details belong.
PARTIES = {"party1": "seller", "party_1": "seller", "supplier": "seller", "vendor": "seller", "party2": "buyer", "party_2": "buyer", "customer": "buyer", "client": "buyer"}
PAYMENT = {"account_number": "seller.account", "bank_name": "seller.bank", "bic": "seller.bik", "bik": "seller.bik", "recipient_account_number": "seller.corr_account", "corr_account": "seller.corr_account"}
# Fields that are numbers, and keys of the number in an amount given as an object.
MONEY, AMOUNT = ("total", "total_with_vat", "total_without_vat", "vat"), ("amount", "value", "sum")
_NONE = "CAST(map() AS map<string,variant>)"


def _get(fields: Column, key: Column | str) -> Column:
    return F.try_element_at(fields, F.lit(key) if isinstance(key, str) else key)


def _without(fields: Column, key: Column) -> Column:
    return F.map_filter(fields, lambda k, _: k != key)


def _put(fields: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(key, value))


def _once(fields: Column, step: Callable[[Column], Column]) -> Column:
    """One step over fields that are computed once. Steps that follow one another aren't nested in each other's lambdas."""
    return F.aggregate(F.array(F.lit(0)), fields, lambda acc, _: step(acc))


def _each(fields: Column, names: Sequence[str], step: Callable[[Column, Column], Column]) -> Column:
    """A step for each of some names in turn."""
    return F.aggregate(F.array(*map(F.lit, names)), fields, step)


def _each_held(fields: Column, names: dict[str, str], step: Callable[[Column, Column, Column], Column]) -> Column:
    """A step for each pair in turn whose first name is a key of the fields; no step makes such a key."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    held = lambda f: F.array_intersect(F.array(*map(F.lit, names)), F.map_keys(f))
    return let(fields, lambda f: F.aggregate(held(f), f, lambda acc, name: step(acc, name, _get(table, name))))


def _set(fields: Column, target: Column, value: Column) -> Column:
    """The value at a dotted path of one or two steps, unless something stands there already. What stands at the first of two
    steps and is no object gives way."""
    top, leaf = F.substring_index(target, ".", 1), F.regexp_extract(target, r"^[^.]*\.(.*)$", 1)
    whole = F.when(trees.empty(_get(fields, top)), _put(fields, top, value)).otherwise(fields)

    def inner(o: Column) -> Column:
        return F.when(trees.empty(_get(o, leaf)), _put(fields, top, F.to_variant_object(_put(o, leaf, value)))).otherwise(fields)

    held = F.coalesce(trees.entries(_get(fields, top)), F.expr(_NONE))
    return F.when(F.contains(target, F.lit(".")), let(held, inner)).otherwise(whole)


def _merge(fields: Column, section: Column, names: dict[str, str], others: bool) -> Column:
    """The fields with those of a section that aren't empty, under their canonical names, in the section's order (a
    canonical name before its aliases); ``others``: those without another name too."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    pairs = F.transform(F.map_entries(section), lambda e: F.struct(F.coalesce(_get(table, e["key"]), e["key"] if others else F.lit(None)).alias("target"), e["value"].alias("value"), e["key"].alias("key")))
    usable = F.filter(pairs, lambda p: p["target"].isNotNull() & ~trees.empty(p["value"]))
    own = let(usable, lambda u: F.concat(F.filter(u, lambda p: p["target"] == p["key"]), F.filter(u, lambda p: p["target"] != p["key"])))
    return F.aggregate(own, fields, lambda acc, p: _set(acc, p["target"], p["value"]))


def _amount(held: Column) -> Column:
    """The number of an amount given as an object, of whose entries; null for null."""
    return F.when(held.isNotNull(), F.coalesce(*[let(_get(held, k), lambda x: F.when(trees.is_number(x), x)) for k in AMOUNT]))


def _flat(fields: Column, keys: tuple[str, ...]) -> Column:
    """Amounts given as objects as their numbers."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*keys), F.coalesce(let(trees.entries(v), _amount), v)).otherwise(v))


def _currencies(fields: Column, keys: tuple[str, ...]) -> Column:
    """Currencies of the amounts given as objects, in the order of ``keys``."""
    named = lambda held: let(_get(held, "currency"), lambda c: F.when((trees.kind(c) == "STRING") & ~trees.empty(c), c))
    return F.array_compact(F.transform(F.array_intersect(F.array(*map(F.lit, keys)), F.map_keys(fields)), lambda k: let(trees.entries(_get(fields, k)), lambda held: F.when(_amount(held).isNotNull(), named(held)))))


def _money(fields: Column) -> Column:
    """Amounts as numbers, of the header and of the items; the first currency found there stands in for a missing one."""
    keys = (*MONEY, "price")

    def with_items(items: Column) -> Column:
        """``items``: entries of each element (null for what is no object) beside the element."""
        flat = F.transform(items, lambda i: F.when(i["held"].isNotNull(), F.to_variant_object(_flat(i["held"], keys))).otherwise(i["own"]))
        out = let(_flat(fields, MONEY), lambda f: F.when(F.size(items) > 0, _put(f, F.lit("items"), F.to_variant_object(flat))).otherwise(f))
        first = lambda held, names: F.when(held.isNotNull(), F.get(_currencies(held, names), F.lit(0)))
        found = F.aggregate(items, first(fields, MONEY), lambda acc, i: F.coalesce(acc, first(i["held"], keys)))
        money = F.when(trees.empty(_get(fields, "currency")), found)
        return let(money, lambda m: F.when(m.isNotNull(), _put(out, F.lit("currency"), m)).otherwise(out))

    return let(F.transform(trees.members(_get(fields, "items")), lambda i: F.struct(i.alias("own"), trees.entries(i).alias("held"))), with_items)


def _party(fields: Column, source: Column, role: Column) -> Column:
    """A party under another name becomes the canonical one, or fills what that one lacks."""

    def move(p: Column) -> Column:
        section, own, own_fields, rest = p["section"], p["own"], p["own_fields"], _without(fields, source)
        filling = F.map_filter(section, lambda k, v: ~trees.empty(v) & trees.empty(_get(own_fields, k)))
        both = F.map_concat(F.map_filter(own_fields, lambda k, _: ~F.map_contains_key(filling, k)), filling)
        moved = F.when(trees.empty(own), _put(rest, role, F.to_variant_object(section))).when(own_fields.isNotNull(), _put(rest, role, F.to_variant_object(both))).otherwise(rest)
        return F.when(section.isNull() | (F.size(section) <= 0), fields).otherwise(moved)

    own = _get(fields, role)
    return let(F.struct(trees.entries(_get(fields, source)).alias("section"), own.alias("own"), trees.entries(own).alias("own_fields")), move)


def canonical_fields(fields: Column) -> Column:
    """Fields (map from key to variant) under their canonical paths: header sections and payment details lifted, parties
    merged, aliases renamed, the array of items under ``items``, amounts as numbers. A canonical path that has a value keeps it.
    Doing it twice changes nothing. Of several aliases of a path in one section the first by name counts."""

    def section(f: Column, name: Column) -> Column:
        return F.when(F.map_contains_key(f, name), let(trees.entries(_get(f, name)), lambda held: F.when(held.isNull(), f).otherwise(_without(_merge(f, held, ALIASES, True), name)))).otherwise(f)

    def payment(f: Column) -> Column:
        name = F.lit("payment_details")
        return F.when(F.map_contains_key(f, name), let(trees.entries(_get(f, name)), lambda held: F.when(held.isNull(), f).otherwise(_without(_merge(f, held, PAYMENT, False), name)))).otherwise(f)

    def renamed(f: Column, name: Column, target: Column) -> Column:
        return let(_get(f, name), lambda held: F.when(trees.empty(held), f).otherwise(_without(_set(f, target, held), name)))

    def items(f: Column) -> Column:
        legacy = F.get(F.filter(F.transform(F.array(*map(F.lit, ITEM_ARRAYS)), lambda k: _get(f, k)), lambda v: F.size(trees.members(v)) > 0), F.lit(0))
        lacking = F.size(trees.members(_get(f, "items"))) == 0
        return let(legacy, lambda v: F.when(lacking & v.isNotNull(), _put(f, F.lit("items"), v)).otherwise(f))

    out = _once(_each(fields, SECTIONS, section), payment)
    out = _each_held(out, PARTIES, _party)
    return _once(_once(_each_held(out, ALIASES, renamed), items), _money)


def canonical_answer(answer: Column) -> Column:
    """A model's answer (JSON text) as a map of the envelope's keys, with ``extracted`` in canonical form. Fields that
    stand without the envelope are put into it, unless it holds something. An answer that is no object gives ``extracted``
    alone, empty; one whose keys are all the envelope's stays as it is."""

    def split(t: Column) -> Column:
        own, loose = _get(t, "extracted"), F.map_filter(t, lambda k, _: ~k.isin(*ENVELOPE))
        wrapped = (F.size(F.coalesce(trees.entries(own), F.expr(_NONE))) > 0) | (F.size(loose) == 0)
        rest = F.map_filter(t, lambda k, _: (k != "extracted") & (k.isin(*ENVELOPE) | wrapped))
        # An ``extracted`` that is no object stays what it is.
        return F.struct(rest.alias("rest"), F.when(wrapped, trees.entries(own)).otherwise(loose).alias("fields"), F.when(wrapped, own).alias("own"))

    def joined(x: Column) -> Column:
        kept = F.when(x["own"].isNotNull(), _put(x["rest"], F.lit("extracted"), x["own"])).otherwise(x["rest"])
        done = _put(x["rest"], F.lit("extracted"), F.to_variant_object(canonical_fields(x["fields"])))
        return F.when(x["fields"].isNull(), kept).otherwise(done)

    shaped = let(let(trees.entries(F.try_parse_json(answer)), lambda t: F.when(t.isNotNull(), split(t))), lambda x: F.when(x.isNotNull(), joined(x)))
    return F.coalesce(shaped, F.create_map(F.lit("extracted"), F.parse_json(F.lit("{}"))))
