"""Trees of unknown shape (VARIANT values parsed from JSON): typed reads that are null where the tree has something else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: White space of all scripts.
SPACES = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def steps(path: str) -> str:
    """``seller.inn`` as a path of a variant."""
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def at(tree: Column, path: str) -> Column:
    """What stands at a dotted path; null where nothing or JSON's null does."""
    return let(F.try_variant_get(tree, steps(path), "variant"), lambda found: F.when(~F.is_variant_null(found), found))


def first(tree: Column, *paths: str) -> Column:
    """The first of several paths that has a value."""
    return F.coalesce(*[at(tree, p) for p in paths])


def kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, FLOAT, BOOLEAN, VOID, ARRAY, OBJECT ... of a variant."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def text(value: Column) -> Column:
    """A variant's trimmed text if it is one and isn't blank."""
    said = lambda v: trimmed(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.get(F.filter(F.transform(F.array(value), said), lambda t: t != ""), F.lit(0))  # read and trimmed once


def text_at(tree: Column, path: str) -> Column:
    return text(F.try_variant_get(tree, steps(path), "variant"))


def is_number(value: Column) -> Column:
    return F.coalesce(kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit(False))


def number(value: Column) -> Column:
    """A variant's number, or that of a text with blanks and one decimal comma; null unless finite."""

    def read(v: Column) -> Column:
        said = F.regexp_replace(F.translate(text(v), SPACES, ""), "^([^,]*),", "$1.")
        digits = F.regexp_extract(said, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", 0)
        return F.when(is_number(v), F.try_variant_get(v, "$", "double")).otherwise(digits.try_cast("double"))

    return F.get(F.filter(F.transform(F.array(value), read), lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(0))


def number_at(tree: Column, path: str) -> Column:
    return number(F.try_variant_get(tree, steps(path), "variant"))


def members(value: Column) -> Column:
    """The elements of an array, an empty one for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.expr("CAST(array() AS array<variant>)"))


def there(value: Column) -> Column:
    """Whether a variant is a value, not missing and not JSON's null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def members_of(value: Column, *names: str) -> Column:
    """The named members of an object, as they are, in one pass over it; null for anything else."""
    return F.try_variant_get(value, "$", _struct(names))


def listed(value: Column, *names: str) -> Column:
    """The named members of each object in an array, in one pass over it; null for other elements, an empty array for
    anything but an array."""
    return F.coalesce(F.try_variant_get(value, "$", f"array<{_struct(names)}>"), F.expr(f"CAST(array() AS array<{_struct(names)}>)"))


def _struct(names: Sequence[str]) -> str:
    return f"struct<{', '.join(f'`{n}`: variant' for n in names)}>"


def entries(value: Column) -> Column:
    """An object as a map from key to variant, null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def empty(value: Column) -> Column:
    """Nothing, JSON's null, an empty text, object or array."""
    held = lambda v: F.try_variant_get(v, "$[0]", "variant").isNotNull()  # noqa: E731  an array that holds anything needn't be written out
    return let(value, lambda v: F.when(v.isNull(), True).when(held(v), False).otherwise(F.schema_of_variant(v).isin("VOID", "OBJECT<>") | F.to_json(v).isin('""', "[]")))


def leaves(json: Column, without: Sequence[str] = ()) -> Column:
    """path and value of every leaf of a JSON object or array, whatever its depth, members named ``without`` and all below
    them left out. Elements have their index as their step; texts, numbers and booleans come as text, JSON's null as null;
    empty objects and arrays have no leaf. Null for what is no JSON, none for a lone value.

    A fold opens one level at a time; there are as many levels as brackets open, at most, so the fold is as long as those."""
    named = lambda path, step: F.when(path == "", step).otherwise(F.concat(path, F.lit("."), step))
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    # Whether a node opens is asked once, where it is found.
    node = lambda path, value: F.struct(path.alias("path"), value.alias("value"), (entries(value).isNotNull() | listed(value).isNotNull()).alias("open"))
    open_ = lambda n: n["open"]

    def inside(n: Column) -> Column:
        own = F.map_entries(entries(n["value"]))
        kept = F.filter(own, lambda e: ~e["key"].isin(*without)) if without else own
        of_object = F.transform(kept, lambda e: node(named(n["path"], e["key"]), e["value"]))
        return F.coalesce(of_object, F.transform(listed(n["value"]), lambda x, i: node(named(n["path"], i.cast("string")), x)))

    def said(v: Column) -> Column:
        whole = lambda x: let(x.try_cast("long"), lambda w: F.when(w == x, w.cast("string")))  # noqa: E731  2e3 is 2000
        return F.coalesce(F.when(F.schema_of_variant(v) == "DOUBLE", let(F.try_variant_get(v, "$", "double"), whole)), F.try_variant_get(v, "$", "string"))

    def level(acc: Column, _: Column) -> Column:
        told = lambda n: F.struct(n["path"].alias("path"), said(n["value"]).alias("value"))
        deeper = let(
            F.flatten(F.transform(acc["open"], inside)),
            lambda kids: F.struct(F.filter(kids, open_).alias("open"), F.concat(acc["leaves"], F.transform(F.filter(kids, lambda n: ~open_(n)), told)).alias("leaves")),
        )
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(deeper)

    tree = F.try_parse_json(json)
    start = F.struct(F.filter(F.array(node(F.lit(""), tree)), open_).alias("open"), F.expr("CAST(array() AS array<struct<path:string,value:string>>)").alias("leaves"))
    levels = F.sequence(F.lit(0), F.length(json) - F.length(F.translate(json, "{[", "")))
    return F.when(tree.isNotNull(), F.aggregate(levels, start, level, lambda acc: acc["leaves"]))
