"""Fields of business documents found in plain text, as Column expressions. A field that isn't found is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Month names as they stand in dates.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
# What labels of a commodity code look like, and the types whose text may hold such codes.
HS_LABEL = r"(?:тн\s?вэд|тнвэд|hs[\s._-]?code|hs[\s._-]?код|код\s+тн\s?вэд|commodity\s+code|код\s+товара)"
HS_TYPES = ("commercial_invoice", "proforma_invoice", "packing_list", "price_list", "contract_specification", "customs_declaration", "delivery_note")
# Labels, container numbers and legal forms.
CONTAINER_LABEL = r"(?:контейн[а-я]*|container|\bконт\.?)"
ORG_FORMS = "(?:ООО|АО|ЗАО|ОАО|ПАО|НАО|ИП|OOO|LLC)"
#: Case-blind, white space and letters of all scripts; digits are written [0-9].
_ANY = "(?iuU)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return let(F.regexp_extract(text, _ANY + pattern, group), lambda x: F.when(x != "", x))


def find_inn(text: Column) -> Column:
    """Twelve or ten digits behind the taxpayer label."""
    return _found(text, r"ИНН[\s:№]*?([0-9]{12}|[0-9]{10})(?![0-9])")


def find_kpp(text: Column) -> Column:
    return _found(text, r"КПП[\s:№]*?([0-9]{9})")


def find_doc_number(text: Column, kind_words: str) -> Column:
    """The token with a digit behind one of the kind words (alternatives of a pattern) and an optional number sign."""
    return _found(text, rf"(?:{kind_words})\s*(?:на\s+оплату\s*)?(?:№|no|n[°º]|#)?\s*([A-ZА-Яa-zа-я0-9\-/]*[0-9][A-ZА-Яa-zа-я0-9\-/]*)")


def find_date(text: Column) -> Column:
    """The first day, month and year of a text as yyyy-mm-dd, else the first with a month's name. Two-digit years are of
    this century; nothing checks that the day exists."""
    number = r"([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{2,4})"

    def by_number(hit: Column) -> Column:
        d, m, y = (F.regexp_extract(hit, number, i) for i in (1, 2, 3))
        year = let(y, lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(F.lpad(y, 4, "0")))
        return F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    named = _ANY + r"([0-9]{1,2})\s+([а-я]+)\s+([0-9]{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, named, 2)))
    by_name = F.when(month > 0, F.concat_ws("-", F.regexp_extract(text, named, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, named, 1), 2, "0")))
    return let(F.regexp_extract(text, number, 0), lambda hit: F.when(hit != "", by_number(hit)).otherwise(by_name))


def parse_amount(raw: Column) -> Column:
    """A number with blanks, and commas as full stops; of several full stops the last is the decimal mark."""

    def read(s: Column) -> Column:
        head, tail = F.regexp_extract(s, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(s, r"^(.*)\.([^.]*)$", 2)
        return F.when(F.contains(s, F.lit(".")), F.concat(F.replace(head, F.lit("."), F.lit("")), F.lit("."), tail)).otherwise(s).try_cast("double")

    return let(F.translate(F.regexp_replace(raw, r"(?U)\s", ""), ",", "."), read)


def find_money(text: Column, *labels: str) -> Column:
    """The first amount behind the first label that has one; shares with a percent sign are passed over."""

    def behind(label: str) -> Column:
        p = rf"{_ANY}{label}[^0-9-]{{0,20}}([0-9][0-9\s.,]*)(\s*%)?"
        hits = F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: ~m.endswith("%"))
        amounts = F.transform(hits, lambda m: parse_amount(F.regexp_extract(m, p, 1)))
        return F.get(F.filter(amounts, lambda a: a.isNotNull()), F.lit(0))

    return F.coalesce(*map(behind, labels))


def find_vat_rate(text: Column) -> Column:
    return _found(text, r"НДС[^%0-9]{0,10}([0-9]{1,2})\s*%").cast("int")


def find_vat(text: Column) -> Column:
    """The first positive amount on a tax line that isn't one without tax; the rate on the line is left out."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(_ANY + "НДС") & ~x.rlike(_ANY + r"без\s+НДС|кроме\s+НДС|НДС\s+не\s+облага"))
    value = lambda x: parse_amount(F.regexp_extract(F.regexp_replace(x, r"^(.*?)[0-9]{1,2}\s*%", "$1 "), r"(?U)([0-9][0-9\s.,]*)", 1))
    return F.get(F.filter(F.transform(lines, value), lambda v: v > 0), F.lit(0))


def completeness(fields: dict[str, Column]) -> Column:
    """confidence (share of the expected fields that are filled, 1 without any) and missing (their names)."""
    if not fields:
        return F.struct(F.lit(1.0).alias("confidence"), F.expr("CAST(array() AS array<string>)").alias("missing"))
    missing = F.array_compact(F.array(*[F.when(c.isNull() | (c.cast("string") == ""), F.lit(n)) for n, c in fields.items()]))
    return F.struct((1 - F.size(missing) / len(fields)).alias("confidence"), missing.alias("missing"))


def tax_pair(text: Column) -> Column:
    """The first two taxpayer numbers of a text: seller's and buyer's."""
    found = F.regexp_extract_all(text, F.lit(_ANY + r"ИНН[\s:№]*?([0-9]{12}|[0-9]{10})(?![0-9])"), F.lit(1))
    return F.struct(F.get(found, F.lit(0)).alias("seller"), F.get(found, F.lit(1)).alias("buyer"))


def transfer_document(text: Column) -> Column:
    """number, date, total, vat, seller and buyer of a universal transfer document."""
    pair = tax_pair(text)
    return F.struct(
        find_doc_number(text, "УПД|счет-фактура|счёт-фактура").alias("number"), find_date(text).alias("date"), find_money(text, r"всего\s+к\s+оплате", "итого").alias("total"),
        find_vat(text).alias("vat"), pair["seller"].alias("seller"), pair["buyer"].alias("buyer"),
    )


def choose_parser(by_pattern: Column, by_model: Column, threshold: float = 0.7) -> Column:
    """``pattern`` or ``model``: patterns stay where the threshold is 0, their confidence exceeds it, or the model gave none;
    else the more confident of both, of equals the patterns."""
    keep = F.lit(threshold == 0) | (by_pattern > threshold) | by_model.isNull() | (by_pattern >= by_model)
    return F.when(keep, "pattern").otherwise("model")


def hs_code(raw: Column) -> Column:
    """Six, eight or ten digits."""
    d = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(d).isin(6, 8, 10), d)


def clean_hs_codes(codes: Column) -> Column:
    """kept (canonical codes, each once) and dropped (what was no code, trimmed) of an array."""
    known = F.array_distinct(F.array_compact(F.transform(codes, hs_code)))
    bad = F.filter(codes, lambda c: hs_code(c).isNull() & (F.trim(c) != ""))
    return F.struct(known.alias("kept"), F.array_distinct(F.transform(bad, lambda c: F.trim(c))).alias("dropped"))


def recover_hs_codes(text: Column) -> Column:
    """Codes within 40 characters behind a label, each once."""
    windows = F.regexp_extract_all(text, F.lit(rf"(?s){_ANY}{HS_LABEL}(?=(.{{0,40}}))"), F.lit(1))
    found = F.flatten(F.transform(windows, lambda w: F.regexp_extract_all(w, F.lit(r"[0-9][0-9 .]{6,14}[0-9]"), F.lit(0))))
    return F.array_distinct(F.array_compact(F.transform(found, hs_code)))


def with_recovered_hs(codes: Column, text: Column, doc_type: Column) -> Column:
    """The codes of a document, and behind them those its text holds, for the types that have such codes."""
    own = F.array_compact(F.transform(F.coalesce(codes, F.expr("CAST(array() AS array<string>)")), hs_code))
    return F.when(doc_type.isin(*HS_TYPES), F.concat(own, F.array_except(recover_hs_codes(text), own))).otherwise(codes)


def recover_containers(text: Column) -> Column:
    """Container numbers (four letters, seven digits) within 80 characters behind a label, each once."""
    windows = F.regexp_extract_all(text, F.lit(rf"(?s){_ANY}{CONTAINER_LABEL}(?=(.{{0,80}}))"), F.lit(1))
    found = F.flatten(F.transform(windows, lambda w: F.regexp_extract_all(w, F.lit("[A-Za-z]{4}[0-9]{7}"), F.lit(0))))
    return F.array_distinct(F.transform(found, F.upper))


def forwarding_client(text: Column) -> Column:
    """A company named before ``hereinafter the client``, else behind a client label; five characters or more."""
    company = rf"{ORG_FORMS}\s*[«\"“']?[^«»\"“”'\n,;()]{{2,80}}[»\"”']?"
    after = _found(text, rf"({company})\s*\(?\s*далее[^)]{{0,25}}?(?:клиент|заказчик)")
    before = _found(text, rf"(?:клиент|заказчик)\s*[:.\-–—]?\s*\n?\s*({company})")
    name = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(after, before), r"(?U)\s+", " ")), r"[\s,;.]+$", "")
    return F.when(F.length(name) >= 5, name)


def forwarding_leg(leg: Column) -> Column:
    """One of the six legs, trimmed and lower-cased, else null."""
    norm = F.lower(F.trim(leg))
    return F.when(norm.isin("air", "road", "rail", "sea", "whole_route", "multimodal"), norm)
