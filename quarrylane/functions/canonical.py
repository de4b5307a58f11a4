"""Canonical forms of an extracted record's fields, by path, for whoever matches records with one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import trees
from .checks import plate
from .records import city
from .text import let, script_kind
from .values import currency, hs_code, normalize_inn

# Paths of taxpayer numbers, of plates, of currencies and of names whose letters tell their origin.
INNS = ("seller.inn", "buyer.inn", "shipper.inn", "consignee.inn", "carrier.inn", "payer.inn", "recipient.inn")
PLATES = ("vehicle.plate", "vehicle.license_plate")
CURRENCIES = ("currency", "declared_value.currency")
SCRIPTS = ("vehicle.plate", "vehicle.trailer_plate", "vehicle.trailer", "vehicle.license_plate", "trailer.plate", "transport_identity.truck_plate", "transport_identity.trailer_plate", "transport.vehicle.plate")
DRIVER = ("driver.fio", "driver.name", "driver.fullName")
# Where either end of a route may stand, in order; of a tuple of paths the first that has a value. True: a name as it is.
ENDS = {
    "from": (("route_from", False), ("transport.route.from", False), ("route.from_city", True), ("route.from", False), (("place_of_loading", "loading_place"), False), ("port_of_loading", False)),
    "to": (("route_to", False), ("transport.route.to", False), ("route.to_city", True), ("route.to", False), (("place_of_delivery", "delivery_place"), False), ("port_of_discharge", False)),
}


def _raw(value: Column) -> Column:
    """A variant's text as it stands, null for other kinds."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _each(pairs: list[tuple[str, Column]], form: Callable[[Column], Column]) -> Column:
    """Entries (key, value) of the forms of several values; the form stands in the plan once."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.transform(rows, lambda e: F.struct(e["key"].alias("key"), form(e["value"]).alias("value")))


def _end(tree: Column, end: str) -> Column:
    names = [F.struct(_raw(trees.first(tree, *([p] if isinstance(p, str) else p))).alias("raw"), F.lit(whole).alias("whole")) for p, whole in ENDS[end]]
    found = F.transform(F.array(*names), lambda n: F.when(n["whole"], F.nullif(trees.trimmed(n["raw"]), F.lit(""))).otherwise(city(n["raw"])))
    return F.get(F.filter(found, lambda n: n.isNotNull()), F.lit(0))


def _listed(tree: Column, path: str, form: Callable[[Column], Column], *leaf: str) -> Column:
    """Entries for the elements of an array (of a field of theirs), by their places."""
    at = lambda x, f: F.try_variant_get(x, trees.steps(f), "string") if f else F.try_variant_get(x, "$", "string")
    key = lambda i, f: F.concat(F.lit(f"{path}."), i.cast("string"), F.lit(f".{f}" if f else "")).alias("key")
    parts = []
    for f in leaf or ("",):
        parts.append(F.transform(trees.members(trees.at(tree, path)), lambda x, i: F.struct(key(i, f), form(at(x, f)).alias("value"))))  # noqa: B023
    return F.concat(*parts)


def canonical_fields(record: Column) -> Column:
    """Canonical values by path of a record (a variant), of those that are valid: taxpayer numbers, plates, references, the
    cities of the route with their fallbacks, containers and seals, currencies, commodity codes, and the script of plates
    and of the driver's name. The record itself stays; a record without any gives an empty map."""

    def read(tree: Column) -> Column:
        capital = lambda x: F.nullif(F.upper(trees.trimmed(x)), F.lit(""))
        said = lambda p: F.try_variant_get(tree, trees.steps(p), "string")
        texts = [("order_ref", trees.text_at(tree, "order_ref")), ("seal_number", trees.text_at(tree, "seal_number"))]
        ends = [(f"route.{end}_canonical", _end(tree, end)) for end in ENDS]
        scripts = [(f"{p}.script", _raw(F.try_variant_get(tree, trees.steps(p), "variant"))) for p in SCRIPTS] + [("driver.script", _raw(trees.first(tree, *DRIVER)))]
        found = F.concat(
            _each([(p, said(p)) for p in INNS], normalize_inn), _each([(p, said(p)) for p in PLATES], plate), _each(texts, capital), _each([("permit_no", trees.text_at(tree, "permit_no")), *ends], lambda x: x),
            _listed(tree, "containers", capital, "number", "seal"), _each([(p, trees.text_at(tree, p)) for p in CURRENCIES], currency), _listed(tree, "hs_codes", hs_code), _listed(tree, "items", hs_code, "hs_code"),
            _each(scripts, script_kind),
        )
        return F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull()))

    return let(record, read)
