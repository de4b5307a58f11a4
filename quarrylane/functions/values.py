"""Canonical forms and checks of business values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Weights of the check digits of a taxpayer number.
INN_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
# Names and signs of currencies, and what units of weight look like.
CURRENCY = {
    "RUB": ("RUB", "РУБ", "Р", "₽", "РУБЛЬ", "РУБЛЕЙ", "RUR"), "EUR": ("EUR", "ЕВРО", "€"), "USD": ("USD", "ДОЛЛ", "ДОЛЛАР", "$", "US$"), "CNY": ("CNY", "ЮАНЬ", "¥", "RMB"), "GBP": ("GBP", "£"),
    "KZT": ("KZT", "ТЕНГЕ", "₸"),
}
TONNES, GRAMS, KILOS = "^(т|тн|tonne|tonnes|ton|tons|t)$", "^(г|гр|g|gr|gram|grams)$", "^(кг|kg|kgs|kilogram|kilograms|kilo)$"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _check(d: Column, weights: tuple[int, ...]) -> Column:
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return (total % 11) % 10


def inn_valid(x: Column) -> Column:
    return let(digits_of(x), _inn_digits_valid)


def _inn_digits_valid(d: Column) -> Column:
    ten = _check(d, INN_10) == F.substring(d, 10, 1).cast("int")
    twelve = (_check(d, INN_11) == F.substring(d, 11, 1).cast("int")) & (_check(d, INN_12) == F.substring(d, 12, 1).cast("int"))
    return F.coalesce(F.when(F.length(d) == 10, ten).when(F.length(d) == 12, twelve), F.lit(False))


def normalize_inn(x: Column) -> Column:
    return F.when(inn_valid(x), digits_of(x))


def parse_number(x: Column) -> Column:
    """The last full stop or comma is the decimal mark."""
    s = F.regexp_replace(x, r"[^0-9.,-]", "")
    whole = F.regexp_replace(F.regexp_extract(s, r"^(.*?)([.,]([0-9]*))?$", 1), "[.,]", "")
    part = F.regexp_extract(s, r"[.,]([0-9]*)$", 1)
    return F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit(""))).try_cast("double")


def weight_kg(value: Column, unit: Column) -> Column:
    """A weight in kilograms, to a gram; the unit may stand behind the value. Null for units that aren't weights."""
    raw = value.cast("string")
    u = F.coalesce(F.nullif(F.trim(unit), F.lit("")), F.regexp_extract(raw, "([a-zA-Zа-яА-Я]+)\\s*$", 1))
    n = parse_number(raw)
    kg = F.when(u.rlike("(?iu)" + TONNES), n * 1000).when(u.rlike("(?iu)" + GRAMS), n / 1000).when(u.rlike("(?iu)" + KILOS) | (u == ""), n)
    return F.floor(kg * 1000 + 0.5) / 1000


def hs_code(x: Column) -> Column:
    d = digits_of(x)
    return F.when(F.length(d).isin(6, 8, 10), d)


def currency(x: Column) -> Column:
    """A currency's code from its code, sign or name; other words of three Latin letters are taken as codes."""
    key = F.regexp_replace(F.upper(F.trim(x)), r"\.$", "")
    out = F.when(key.rlike("^[A-Z]{3}$"), key)
    for code, names in CURRENCY.items():
        out = F.when(key.isin(*names), F.lit(code)).otherwise(out)
    return out


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(x), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))
