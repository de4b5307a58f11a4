"""Validators, routing and recovered fields as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let
from .values import inn_valid

# Latin letters that stand for Cyrillic ones on vehicle plates, and tax rates a derived rate snaps to.
PLATE_LATIN, PLATE_CYRILLIC = "ABEKMHOPCTYX", "АВЕКМНОРСТУХ"
TAX_RATES = (0, 5, 7, 10, 18, 20, 22)
PLATE = f"^[{PLATE_CYRILLIC}][0-9]{{3}}[{PLATE_CYRILLIC}]{{2}}[0-9]{{2,3}}$"
# Tax rates of lines, and units of measure.
LINE_RATES = (0, 5, 7, 10, 20)
UNITS = (
    "шт", "штука", "штук", "pcs", "pc", "кг", "kg", "г", "грамм", "граммов", "тонна", "т", "м", "метр", "метров", "m", "м²", "м^2", "кв.м", "кв. м", "кв.м.", "м³", "м^3", "куб.м", "куб. м", "куб.м.",
    "л", "литр", "литров", "мл", "упак", "упаковка", "упак.", "pack", "packages", "компл", "комплект", "компл.", "набор", "час", "часов", "мин", "сек", "день", "месяц", "усл.ед", "у.е.", "уе",
)


def money_sanity(field: str) -> Column:
    return F.when(~F.col(field).between(0, 1e12), F.lit(f"{field} out of range"))


def parties_differ(a: str, b: str) -> Column:
    return F.when(F.col(a) == F.col(b), F.lit(f"{a} equals {b}"))


def date_range(field: str, first: str = "2010-01-01", last: str | None = None) -> Column:
    """Wrong form, a day that the calendar lacks, or one before ``first`` or after ``last`` (30 days from today)."""
    x = F.regexp_replace(F.col(field).cast("string"), " 00:00:00$", "")  # of a timestamp
    day = F.try_to_date(x, "yyyy-MM-dd")
    end = F.lit(last).cast("date") if last else F.date_add(F.current_date(), 30)
    return F.when(~x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(f"{field} malformed")).when(day.isNull() & x.isNotNull(), F.lit(f"{field} doesn't exist")).when((day < F.lit(first).cast("date")) | (day > end), F.lit(f"{field} out of range"))


def weight_nett_le_gross(nett: str, gross: str) -> Column:
    return F.when(F.col(nett) > F.col(gross), F.lit("nett exceeds gross"))


def inn_checksum(field: str) -> Column:
    return F.when((F.col(field) != "") & ~inn_valid(F.col(field)), F.lit(f"{field} has a wrong check digit"))


def kpp_format(field: str) -> Column:
    return F.when(~F.col(field).rlike("^[0-9]{4}[A-Z0-9]{2}[0-9]{3}$"), F.lit(f"{field} malformed"))


def vehicle_plate(field: str) -> Column:
    return F.when(~F.upper(F.regexp_replace(field, r"\s", "")).rlike(PLATE), F.lit(f"{field} malformed"))


def country_code(field: str) -> Column:
    return F.when(~F.col(field).rlike("^[A-Z]{2}$"), F.lit(f"{field} malformed"))


def vat_consistency(total: str = "total", vat: str = "vat", rate: str = "vat_rate") -> Column:
    due = F.col(total) * F.col(rate) / (100 + F.col(rate))
    return F.when(F.abs(F.col(vat) - due) > F.greatest(F.lit(1.0), 0.005 * F.col(total)), F.lit(f"{vat} doesn't fit {rate}"))


def _line_total(x: Column) -> Column:
    return F.coalesce(x["total_with_vat"], x["total"])


def items_total_sum(field: str = "total", tolerance: str = "0.02") -> Column:
    """The lines' totals against the header's; lines without one add nothing."""
    summed = F.aggregate("items", F.lit(0.0), lambda s, x: s + F.coalesce(_line_total(x), F.lit(0.0)))
    return F.when((F.size("items") > 0) & (F.abs(summed - F.col(field)) > float(tolerance)), F.lit(f"items don't add up to {field}"))


def _bad_lines(what: str, bad: Callable[[Column], Column]) -> Column:
    """An issue that names the first ten lines (from 1) that are bad."""
    at = F.array_compact(F.transform("items", lambda x, i: F.when(bad(x), (i + 1).cast("string"))))
    return F.when(F.size(at) > 0, F.concat(F.lit(f"{what} in lines "), F.array_join(F.slice(at, 1, 10), ",")))


def items_vat_rates() -> Column:
    return _bad_lines("vat_rate", lambda x: ~x["vat_rate"].isin(*LINE_RATES))


def items_unit_known() -> Column:
    return _bad_lines("unit", lambda x: (x["unit"] != "") & ~F.lower(F.trim(x["unit"])).isin(*UNITS))


def items_line_consistency() -> Column:
    return _bad_lines("total", lambda x: F.abs(x["qty"] * x["price"] - F.coalesce(x["total_without_vat"], x["total"])) > 0.02)


def items_hs_code_format() -> Column:
    return _bad_lines("hs_code", lambda x: (x["hs_code"] != "") & ~F.regexp_replace(x["hs_code"], r"\s", "").rlike("^([0-9]{8}|[0-9]{10})$"))


_ALL = (money_sanity, parties_differ, date_range, weight_nett_le_gross, inn_checksum, kpp_format, vehicle_plate, country_code, vat_consistency)
_ALL += (items_total_sum, items_vat_rates, items_unit_known, items_line_consistency, items_hs_code_format)
VALIDATORS = {f.__name__: f for f in _ALL}
# What a type's records are checked for where its own row names no validators.
_INVOICE = ("inn_checksum:seller_inn", "inn_checksum:buyer_inn", "parties_differ:seller_inn,buyer_inn", "money_sanity:total", "vat_consistency")
BY_TYPE = {
    "invoice": _INVOICE,
    "factInvoice": _INVOICE,
    "UPD": _INVOICE,
    "TTN": ("inn_checksum:seller_inn", "vehicle_plate:plate"),
    "CMR": ("country_code:country", "weight_nett_le_gross:nett,gross"),
    "AKT": ("inn_checksum:seller_inn", "inn_checksum:buyer_inn", "parties_differ:seller_inn,buyer_inn", "money_sanity:total"),
}


def issues_by_type(doc_type: Column, specs: dict[str, Sequence[str]], dated: Sequence[str] = ("date_range:date",)) -> Column:
    """Issues under the specs of each row's type, then under ``dated``, which every type is checked for. Types with equal specs
    share an expression; a type without specs has only the latter's."""
    out = F.expr("CAST(array() AS array<string>)")
    for own in dict.fromkeys(map(tuple, specs.values())):
        out = F.when(doc_type.isin(*[name for name, s in specs.items() if tuple(s) == own]), issues(own)).otherwise(out)
    return F.concat(out, issues(dated))


def issues(specs: Sequence[str]) -> Column:
    """Issues of a row under ``name:arg,arg`` specs, in their order; unknown names are skipped, missing fields pass."""
    known = [s.partition(":") for s in specs]
    found = [VALIDATORS[name](*[a.strip() for a in args.split(",") if a.strip()]) for name, _, args in known if name in VALIDATORS]
    return F.array_compact(F.array(*found)) if found else F.expr("CAST(array() AS array<string>)")


def plate(x: Column) -> Column:
    """A vehicle plate in Cyrillic capitals, null if it has no plate's shape. Digits at letters' places and letters at digits'
    places are read as what they look like."""
    letter = lambda c: F.translate(c, "038", "ОЗВ")
    digit = lambda c: F.translate(c, "ОЗВI", "0381")

    def shaped(p: Column) -> Column:
        fixed = F.concat(letter(F.substring(p, 1, 1)), digit(F.substring(p, 2, 3)), letter(F.substring(p, 5, 2)), digit(F.substring(p, 7, 3)))
        return F.when(F.length(p).between(8, 9), let(fixed, lambda f: F.when(f.rlike(PLATE), f)))

    return let(F.translate(F.upper(F.regexp_replace(x, r"[\s\-_.,;:]", "")), PLATE_LATIN, PLATE_CYRILLIC), shaped)


def inn_confidence(valid: Column, length: Column, given: Column) -> Column:
    """Confidence of a taxpayer number: at most 0.3 with a wrong length, halved with a wrong check digit, else 0.95 or more."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(given, F.lit(0.7))))
    c = F.when(~length.isin(10, 12), F.least(c, F.lit(0.3))).when(~valid, F.when(given.isNull(), F.lit(0.3)).otherwise(c * 0.5)).otherwise(F.greatest(c, F.lit(0.95)))
    return F.floor(c * 100 + 0.5) / 100


def names_match(a: Column, b: Column) -> Column:
    """One name contains the other, letters and digits only; an empty or missing first name matches."""
    x, y = (F.regexp_replace(F.lower(F.coalesce(n, F.lit(""))), r"[^\p{L}\p{N}]", "") for n in (a, b))
    return (x == "") | F.contains(x, y) | F.contains(y, x)


def bottleneck(steps: Sequence[str]) -> Column:
    """Name of the slowest step, of equals the first."""
    most = F.greatest(*steps)
    out = F.lit(None).cast("string")
    for s in reversed(steps):
        out = F.when(F.col(s) == most, F.lit(s)).otherwise(out)
    return out


def extract_route(force: Column, prefer_vision: Column, scanned: Column, confidence: Column, chars: Column, pages: Column) -> Column:
    """text or image: forced first, then a preference, scans, low confidence and sparse text go by image."""
    return F.when(force.isin("text", "image"), force).when(prefer_vision | scanned | (confidence < 0.7) | (chars < pages * 80), "image").otherwise("text")


def format_kind(mime: Column, name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(mime == "application/pdf", "pdf").when(mime.like("image/%"), "image").when(mime.rlike("xml$") & ~mime.like("%officedocument%"), "xml").when(mime.like("%spreadsheet%") | (mime.like("%x-cfb") & (ext == "xls")), "excel").when(mime.like("%wordprocessing%") | (mime.like("%x-cfb") & (ext == "doc")), "word").otherwise("other")


def split_pages(text: Column) -> Column:
    """Pages between form feeds, else from page marker to page marker with what stands before the first; blank parts go. An
    empty array if that makes fewer than two."""
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    parts = lambda p: F.filter(F.transform(F.split(text, p, -1), trim), lambda x: x != "")
    marker = r"(?imuU)(?=^[ \t]*(?:страница|стр\.?|page|seite|lapa|puslapis|lehekülg)[ \t]*[№#]?[ \t]*[0-9]+\b)"
    feeds, marks = parts("\f"), parts(marker)
    marked = (F.size(marks) >= 2) & (F.regexp_count(text, F.lit(marker)) >= 2)
    return F.when(F.size(feeds) >= 2, feeds).when(marked, marks).otherwise(F.expr("CAST(array() AS array<string>)"))


def url_problem(url: Column, hosts: Sequence[str] = ()) -> Column:
    """Why a URL may not be fetched: malformed, scheme, host; null if it may. Without ``hosts`` all hosts may."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    banned = host.isNull() | (~host.isin(*hosts) if hosts else F.lit(False))
    return F.when(scheme.isNull(), "malformed").when(~scheme.isin("http", "https"), "scheme").when(banned, "host")


def private_ip(ip: Column) -> Column:
    """Whether an address is no public one: private, loopback, link-local, carrier, multicast or reserved; malformed ones are
    private too."""
    v4 = F.lower(F.regexp_extract(ip, r"^(?:::ffff:)?([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})$", 1))
    a, b, c, d = (F.get(F.split(v4, r"\."), F.lit(i)).try_cast("int") for i in range(4))
    wrong = F.greatest(a, b, c, d) > 255
    inner = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    v6 = F.lower(F.substring_index(ip, "%", 1))
    inner6 = v6.isin("::1", "::") | v6.rlike("^(fe80|fc|fd|ff)") | ~v6.rlike("^[0-9a-f:]*:[0-9a-f:.]*$")
    return F.when(v4 != "", wrong | inner).otherwise(F.coalesce(inner6, F.lit(True)))


def fx_feed(xml: Column) -> Column:
    """(code, rate per unit, nominal, day) of the entries of a daily rates feed; entries without a number are left out, and
    a feed without a date has none."""
    day = F.try_to_date(F.regexp_extract(xml, r"Date=[\"']([0-9.]+)[\"']", 1), "dd.MM.yyyy")
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<Valute[^>]*>(.*?)</Valute>"), F.lit(1))
    number = lambda e, tag: F.replace(F.regexp_extract(e, f"<{tag}>([0-9,.]+)</{tag}>", 1), F.lit(","), F.lit(".")).try_cast("double")
    rows = F.transform(entries, lambda e: F.struct(F.regexp_extract(e, "<CharCode>([A-Z]{3})</CharCode>", 1).alias("code"), (number(e, "Value") / number(e, "Nominal")).alias("rate"), number(e, "Nominal").cast("int").alias("nominal"), day.alias("day")))
    return F.filter(rows, lambda r: r["rate"].isNotNull() & (r["code"] != "") & day.isNotNull())
