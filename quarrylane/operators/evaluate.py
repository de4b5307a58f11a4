"""Extraction quality against expected values: rows of id, path, kind, expected, actual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import digits_of


def plain(x: Column) -> Column:
    """Lower case, without quotation marks, and full stops, commas and semicolons as blanks. Compatibility forms aren't
    folded: Spark has no such built-in."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), "[\"'«»]", ""), "[.,;]", " "), r"(?U)\s+", " "))


def money(x: Column) -> Column:
    """A number without blanks, signs and names of currencies; commas are full stops."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?U)\s", ""), "[₽$€£¥]", ""), r"(?iu)руб\.?", "")
    s = F.replace(F.regexp_replace(s, r"(?i)\b(RUB|USD|EUR|GBP|JPY)\b", ""), F.lit(","), F.lit("."))
    return F.when(s == "", 0.0).otherwise(s.try_cast("double"))


def percent(x: Column) -> Column:
    """A percentage; 1 and less are shares."""
    n = F.replace(F.regexp_replace(x, r"(?U)[\s%]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(n <= 1, n * 100).otherwise(n)


def day(x: Column) -> Column:
    """yyyy-mm-dd of such a date, with or without a time, or of day, month and year between full stops or slashes."""
    s = F.trim(x)
    iso = F.regexp_extract(s, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T\s].*)?$", 1)
    d, m, y = (F.regexp_extract(s, "^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})$", i) for i in (1, 2, 3))
    return F.when(iso != "", iso).when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def kind_of(path: Column) -> Column:
    """The comparator that a field's path suggests."""
    p = F.lower(path)
    rules = (
        (r"(^|\.)inn$", "inn"), (r"(^|\.)kpp$", "kpp"), ("account", "account"), ("plate|^(?=.*vehicle).*_number$", "plate"), ("country$|_code$", "country"), (r"(^|\.|_)date$", "date"),
        ("rate|percent", "percent"), ("total|amount|price|sum|vat|cost", "money"), ("weight|volume|qty", "number"),
    )
    out = F.lit("string")
    for pattern, kind in reversed(rules):
        out = F.when(p.rlike(pattern), kind).otherwise(out)
    return out


def outcome(kind: Column, expected: Column, actual: Column) -> Column:
    """match, mismatch or missing by eleven kinds of comparison. What isn't expected always matches."""
    close = lambda f, by: F.abs(f(expected) - f(actual)) <= by
    digits = lambda x: F.nullif(digits_of(x), F.lit(""))
    whole = lambda x: F.floor(money(x) + 0.5)
    plates = lambda x: F.nullif(F.upper(F.regexp_replace(x, r"(?U)[\s-]", "")), F.lit(""))
    same = (
        F.when(kind.isin("money", "number"), close(money, 0.01 + 1e-9))
        .when(kind == "percent", close(percent, 0.01 + 1e-9))
        .when(kind == "integer", whole(expected) == whole(actual))
        .when(kind == "date", day(expected) == day(actual))
        .when(kind.isin("inn", "kpp", "account", "digits"), digits(expected) == digits(actual))
        .when(kind == "plate", plates(expected) == plates(actual))
        .when(kind == "country", F.upper(F.trim(expected)) == F.upper(F.trim(actual)))
        .otherwise(plain(expected) == plain(actual))
    )
    absent = lambda x: x.isNull() | (F.trim(x) == "")
    return F.when(absent(expected), "match").when(absent(actual), "missing").when(F.coalesce(same, F.lit(False)), "match").otherwise("mismatch")


def field_metrics(rows: DataFrame) -> DataFrame:
    t = rows.withColumn("o", outcome(F.col("kind"), F.col("expected"), F.col("actual")))
    n = lambda o: F.count_if(F.col("o") == o)
    decided = n("match") + n("mismatch")
    return t.groupBy("path").agg(F.count("*").alias("n"), n("match").alias("matched"), n("missing").alias("missing"), F.when(decided > 0, n("match") / decided).alias("accuracy"), (decided / F.count("*")).alias("coverage"))
