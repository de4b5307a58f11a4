"""Document type names: their forms, corrections, and the choice between what rules, file names and a model say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of types outside and inside.
OUTSIDE = {"TTN": "ttn", "UPD": "upd", "UKD": "ukd", "CMR": "cmr", "AKT": "services_act", "factInvoice": "tax_invoice"}
# Marks of file names, the first that fits wins.
FILE_MARKS = (
    (r"(?:коносамент|(?<![a-z])(?:m|h|a|b|c)?bl(?![a-z])|hbtelex)", "bill_of_lading"),
    (r"(?:gtd|гтд|декларация\s+на\s+товары)", "customs_declaration"),
    (r"vat.?invoice", "factInvoice"),
    (r"(?:акт.?взвешив|взвешив|weighing)", "weighing_act"),
    (r"(?:pi-|pi20|pfa|proforma|проформа)", "proforma_invoice"),
    (r"commercial.?invoice", "commercial_invoice"),
    (r"packing.?list", "packing_list"),
    (r"ттн", "TTN"),
    (r"(?<![a-z])awb(?![a-z])", "awb"),
    (r"(?:(?<![a-z])act[_\- ]|(?<![а-я])акт(?![а-я]))", "AKT"),
    (r"(?:(?<![a-z])invoice(?![a-z])|сч[её]т)", "invoice"),
    (r"(?:еаэс|conformity)", "eac_conformity_certificate"),
    (r"(?:контракт|contract)", "contract"),
    (r"заявка", "transport_request"),
)
# Words of specifications, prices, currencies and weights.
SPEC_WORDS = r"\bspecification\b|спецификаци|especificaci|spezifikation|\bspecifikacij"
PRICES = r"(unit\s*price|цена|стоимост|precio|preis|prix|amount\s*due|к\s*оплате|total\s*amount)|(€|\$|₽|£|\bEUR\b|\bUSD\b|\bRUB\b|\bGBP\b|\bPLN\b)"
WEIGHTS = r"(нетто|брутто|net\s*weight|gross\s*weight|паллет|pallet|packages|грузовых\s*мест|мест\b)"
# The broad types and their labels.
BROAD = {
    "contract": "Договор", "certificate": "Сертификат", "invoice_like": "Счёт-подобный", "transport_doc": "Транспортный", "customs_doc": "Таможенный", "bank_doc": "Банковский", "letter": "Письмо",
    "correspondence_screenshot": "Скриншот переписки", "id_document": "Удостоверение личности", "tech_doc": "Техдокументация", "drawing": "Чертёж", "product_photo": "Фото товара", "cargo_photo": "Фото погрузки",
    "price_list": "Прайс-лист", "report_table": "Отчёт/таблица", "form_application": "Форма/заявление", "not_a_document": "Не документ", "other": "Прочее",
}
#: Weight of a file name's mark alone, and what agreement with the text adds.
FILE_WEIGHT, AGREEMENT = 5.5, 1.0


def _mapped(x: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), x), x)


def outside(slug: Column) -> Column:
    """The name that the interface gives a type."""
    return _mapped(slug, OUTSIDE)


def inside(slug: Column) -> Column:
    """The name under which a built-in type is kept."""
    return _mapped(slug, {v: k for k, v in OUTSIDE.items()})


def forms(slug: Column) -> Column:
    """All names of a type, its own first."""
    return F.array_distinct(F.array(slug, outside(slug), inside(slug)))


def is_type(column: Column, slug: str) -> Column:
    """Rows of a type under any of its names."""
    back = {v: k for k, v in OUTSIDE.items()}
    return column.isin(*dict.fromkeys((slug, OUTSIDE.get(slug, slug), back.get(slug, slug))))


def clean_slug(answer: Column) -> Column:
    """The first word of a model's answer in a-z, 0-9 and underscore; null for none and for unknown."""
    first = F.get(F.split(F.trim(F.regexp_replace(answer, r"(?U)\s+", " ")), " "), F.lit(0))
    slug = F.regexp_replace(F.lower(first), "[^a-z0-9_]", "")
    return F.when(~slug.isin("", "unknown"), slug)


def broad_slug(slug: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.trim(F.coalesce(slug, F.lit("")))), "[^a-z0-9_]", "")
    return F.when(clean.isin(*BROAD), clean).otherwise("other")


def broad_label(slug: Column) -> Column:
    return _mapped(broad_slug(slug), BROAD)


def file_mark(name: Column) -> Column:
    """The type that a file's base name without extension points to."""
    stem = F.regexp_replace(F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), "([^/]*)$", 1), r"(?i)\.[a-z0-9]{1,5}$", "")
    out = F.lit(None).cast("string")
    for pattern, slug in reversed(FILE_MARKS):
        out = F.when(stem.rlike("(?iu)" + pattern), F.lit(slug)).otherwise(out)
    return out


def fuse_file_mark(best: Column, weight: Column, in_title: Column, mark: Column, mark_weight: Column) -> Column:
    """slug and weight from the text's best type (slug, weight, whether it stood in the title), the file's mark and the
    weight of the mark's type in the text, null for none."""
    own = F.coalesce(mark_weight + AGREEMENT, F.lit(FILE_WEIGHT))
    of_text, of_file = F.struct(best.alias("slug"), weight.alias("weight")), F.struct(mark.alias("slug"), own.alias("weight"))
    agreed = F.struct(best.alias("slug"), (weight + AGREEMENT).alias("weight"))
    return F.when(mark.isNull(), of_text).when(best == mark, agreed).when(best.isNotNull() & in_title, of_text).when(best.isNull() | (own >= weight), of_file).otherwise(of_text)


def arbitrate(prior: Column, confidence: Column, answer: Column, failed: Column, known: Column, confident: float = 0.5) -> Column:
    """type, confidence, method from the rules' type and a model's answer. A known type wins (at least 0.9 where both agree,
    0.7 without a prior, 0.5 in conflict). ``unknown`` leaves a prior of ``confident`` or more; an error or a type
    outside the catalogue leaves any prior."""
    said = F.nullif(F.trim(answer), F.lit(""))
    nothing = said.isNull() | F.lower(said).isin("unknown", "null")
    out = lambda t, c, m: F.struct(t.cast("string").alias("type"), (F.floor(c * 1000 + 0.5) / 1000).alias("confidence"), F.lit(m).alias("method"))
    fallback = out(prior, F.when(prior.isNull(), 0.0).otherwise(confidence), "fallback")
    sure = F.when(prior == said, F.greatest(F.lit(0.9), confidence)).when(prior.isNull(), F.lit(0.7)).otherwise(F.lit(0.5))
    unknown = F.when(prior.isNotNull() & (confidence >= confident), fallback).otherwise(out(F.lit(None), F.lit(0.0), "llm"))
    return F.when(failed, fallback).when(nothing, unknown).when(known, out(said, sure, "llm")).otherwise(fallback)


def correct_specification(slug: Column, text: Column) -> Column:
    """A commercial invoice that calls itself a specification at its head and names no prices is one."""
    spec = F.substring(text, 1, 500).rlike("(?iu)" + SPEC_WORDS) & ~text.rlike("(?iu)" + PRICES)
    return F.when((slug == "commercial_invoice") & spec, "contract_specification").otherwise(slug)


def correct_weight_page(slug: Column, text: Column) -> Column:
    """A price list or invoice page with weights and no prices is a packing list."""
    packing = slug.isin("price_list", "commercial_invoice") & ~text.rlike("(?iu)" + PRICES) & text.rlike("(?iu)" + WEIGHTS)
    return F.when(packing, "packing_list").otherwise(slug)


def catalogue_line(slug: Column, description: Column, prompt: Column, most: int = 80) -> Column:
    """A catalogue's line for a type: its description, else the first ``most`` characters of its prompt."""
    d = F.coalesce(F.nullif(F.trim(description), F.lit("")), F.nullif(F.substring(F.regexp_replace(F.trim(prompt), r"(?U)\s+", " "), 1, most), F.lit("")))
    return F.when(d.isNull(), slug).otherwise(F.concat(slug, F.lit(" — "), d))


def deep_verdict(broad: Column, candidate: Column, known: Column) -> Column:
    """slug and verdict of a second look: ``mapped`` to a known type, ``not_a_document``, else ``foreign_document``. An
    identity document is never mapped."""
    b = broad_slug(broad)
    clean = F.regexp_replace(F.lower(F.trim(candidate)), "[^a-z0-9_]", "")
    slug = F.when((b != "id_document") & ~clean.isin("", "null", "unknown") & known, clean)
    return F.struct(b.alias("broad"), slug.alias("slug"), F.when(slug.isNotNull(), "mapped").when(b == "not_a_document", "not_a_document").otherwise("foreign_document").alias("verdict"))


def engine_chain(engines: Column, external: Sequence[str], personal: Column, allowed: Column, local_scans: Sequence[str], prefer_external: bool = False) -> Column:
    """Names of the engines (name, available, supports) to try, in order. External ones are left out where they aren't
    allowed or the document is personal; with ``prefer_external`` they come before the first local scan engine."""
    usable = F.filter(engines, lambda e: e["available"] & e["supports"] & ~(e["name"].isin(*external) & (personal | ~allowed)))
    names = F.transform(usable, lambda e: e["name"])
    if not prefer_external:
        return names
    first = F.coalesce(F.array_min(F.filter(F.transform(names, lambda n, i: F.when(n.isin(*local_scans), i)), lambda i: i.isNotNull())), F.size(names))
    head, rest = F.slice(names, 1, first), F.slice(names, first + 1, F.size(names))
    mine = lambda n: n.isin(*external)
    return F.concat(head, F.filter(rest, mine), F.filter(rest, lambda n: ~mine(n)))
