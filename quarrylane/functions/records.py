"""Extracted records as maps of dotted path to value (``seller.inn``), their normalisation, privacy and quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from .checks import plate
from .values import digits_of, inn_valid, normalize_inn

NO_TEXT = "CAST(array() AS array<string>)"
# Parties, keys and types that rules speak of.
OGRN_PARTIES = ("seller", "buyer", "sender", "recipient", "declarant", "consignee", "shipper", "payer", "payee", "party_a", "party_b")
INN_PARTIES = ("seller", "buyer", "shipper", "consignee", "carrier", "payer", "recipient", "client", "expeditor")
INVOICE_TYPES = ("invoice", "factInvoice", "tax_invoice")
ID_TYPES, ID_KEYS = ("driver_passport", "id_document", "passport"), ("doc_kind", "country", "present")
LEGACY_ITEMS = ("positions", "services", "goods", "line_items")
CRITICAL = ("number", "date", "seller.inn", "buyer.inn", "total_with_vat")
# Fields that hold personal data.
PERSONAL = (
    "vehicle.driver", "vehicle.driver_name", "vehicle.driver_phone", "vehicle.driver_phone2", "vehicle.driver_passport", "vehicle.driver_license", "seller.contact_person", "buyer.contact_person",
    "shipper.contact_person", "consignee.contact_person", "carrier.contact_person", "signatory", "signatory_name", "executor_name", "recipient_name_individual", "holder.name", "driver", "driver_name",
    "full_name", "surname", "given_names", "name_individual", "date_of_birth", "dob", "passport_number", "passport_no", "personal_number", "personal_code", "mrz",
)
# Keys whose values are secrets, and how secret values begin.
SECRET_KEYS = r"(?i)^(password|passwd|pwd|secret|token|api[_-]?key|apikey|auth(orization)?|credentials?|private[_-]?key|access[_-]?key|refresh[_-]?token|client[_-]?secret)$"
SECRET_VALUES = r"^(sk-ant-[A-Za-z0-9_-]{20,}|sk-proj-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{20,}|[pr]k_(live|test)_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}$|ya29\.[A-Za-z0-9_-]{20,}|gh[po]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{20,}|xox[abp]-[A-Za-z0-9-]{20,})"
BLEED = r"(here'?s|let me|thinking|reasoning|i'?ll|first,|okay,|давайте|разбер|подума)"


def path(record: Column, name: str) -> Column:
    return F.try_element_at(record, F.lit(name))


def filled(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def _entries(*pairs: tuple[Column, Column, Column]) -> Column:
    """Entries (key, value) of those triples (when, key, value) that apply."""
    return F.array_compact(F.array(*[F.when(on, F.struct(k.alias("key"), v.cast("string").alias("value"))) for on, k, v in pairs]))


def updated(record: Column, entries: Column) -> Column:
    """The record with new entries in place of old ones."""
    new = F.map_from_entries(entries)
    return F.map_concat(F.map_filter(record, lambda k, _: ~F.map_contains_key(new, k)), new)


def relocate_ogrn(record: Column) -> Column:
    """Registration numbers (13 or 15 digits) that stand as taxpayer numbers move to ``ogrn``, unless that is filled."""
    pairs = []
    for p in OGRN_PARTIES:
        d = digits_of(path(record, f"{p}.inn"))
        wrong = F.length(d).isin(13, 15)
        pairs += [(wrong, F.lit(f"{p}.inn"), F.lit(None)), (wrong & ~filled(path(record, f"{p}.ogrn")), F.lit(f"{p}.ogrn"), d)]
    return updated(record, _entries(*pairs))


def relocated(record: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.length(digits_of(path(record, f"{p}.inn"))).isin(13, 15), F.lit(p)) for p in OGRN_PARTIES]))


def sanitize_inns(record: Column) -> Column:
    """Taxpayer numbers as their digits where the check digits fit, else null."""
    return updated(record, _entries(*[(filled(path(record, f"{p}.inn")), F.lit(f"{p}.inn"), normalize_inn(path(record, f"{p}.inn"))) for p in INN_PARTIES]))


def dropped_inns(record: Column) -> Column:
    """Path and raw value of the numbers that ``sanitize_inns`` drops."""
    raw = lambda p: path(record, f"{p}.inn")
    return F.map_from_entries(_entries(*[(filled(raw(p)) & normalize_inn(raw(p)).isNull(), F.lit(f"{p}.inn"), raw(p)) for p in INN_PARTIES]))


def suspect_letter(doc_type: Column, n_positions: Column, total: Column, total_with_vat: Column) -> Column:
    """An invoice without positions and totals is likely a letter; its currency doesn't count."""
    empty = lambda t: F.coalesce((F.trim(t) == "") | (F.replace(t, F.lit(","), F.lit(".")).try_cast("double") == 0), F.lit(True))
    return doc_type.isin(*INVOICE_TYPES) & (F.coalesce(n_positions, F.lit(0)) == 0) & empty(total) & empty(total_with_vat)


def id_allow_list(record: Column, doc_type: Column) -> Column:
    """Of an identity document only its kind, country and presence stay."""
    is_id = F.coalesce(doc_type.isin(*ID_TYPES), F.lit(False)) | F.coalesce(path(record, "doc_kind") == "id", F.lit(False))
    kept = F.map_filter(record, lambda k, _: k.isin(*ID_KEYS))
    missing = _entries((~F.map_contains_key(kept, "doc_kind"), F.lit("doc_kind"), F.lit("id")), (~F.map_contains_key(kept, "present"), F.lit("present"), F.lit("true")))
    return F.when(is_id, F.map_concat(kept, F.map_from_entries(missing))).otherwise(record)


def id_segment(text: Column) -> Column:
    """What is kept of an identity page: its kind, and the country of its machine-readable line."""
    country = F.regexp_extract(text, "P<([A-Z]{3})", 1)
    return F.map_concat(F.create_map(F.lit("doc_kind"), F.lit("id"), F.lit("present"), F.lit("true")), F.map_from_entries(_entries((country != "", F.lit("country"), country))))


def mask_id_pages(pages: Column) -> Column:
    """Pages (struct of text and type) with identity pages replaced and passport data on the others scrubbed."""
    return F.transform(pages, lambda p: F.when(p["type"].isin(*ID_TYPES), F.lit("[ID PAGE]")).otherwise(scrub_passports(p["text"])))


# The sign of a city before its name.
CITY_SIGN = r"(?iuU)^\s*(?:г\.?|город)\s+"


def city(raw: Column) -> Column:
    """The name of a city: without its sign, up to a comma or bracket."""
    name = F.trim(F.get(F.split(F.regexp_replace(raw, CITY_SIGN, ""), r"[,(]"), F.lit(0)))
    return F.nullif(name, F.lit(""))


def lift_items(items: Column | None, legacy: dict[str, Column]) -> Column:
    """The items array, else the first legacy one that isn't empty."""
    return F.coalesce(*([] if items is None else [items]), *[F.when(F.size(legacy[k]) > 0, legacy[k]) for k in LEGACY_ITEMS if k in legacy])


def business_fields(record: Column) -> Column:
    """Number of filled fields at the top, those that begin with an underscore left out; nested ones count once."""
    keys = F.map_keys(F.map_filter(record, lambda k, v: ~F.startswith(k, F.lit("_")) & filled(v)))
    return F.size(F.array_distinct(F.transform(keys, lambda k: F.substring_index(k, ".", 1))))


def field_confidence(record: Column, given: Column) -> Column:
    """Confidence by path: those given (0 to 1), 0.7 for critical fields that are filled, then what check digits and plates
    say, in hundredths."""
    base = F.map_filter(given, lambda _, v: v.between(0, 1))
    at = lambda p: F.try_element_at(base, F.lit(p))
    rules = {p: F.coalesce(at(p), F.when(filled(path(record, p)), F.lit(0.7))) for p in CRITICAL}
    for party in ("seller", "buyer", "shipper", "consignee", "carrier"):
        p = f"{party}.inn"
        raw, own = path(record, p), rules.get(p, at(p))
        right_size = F.length(digits_of(raw)).isin(10, 12)
        rules[p] = F.when(raw.isNull(), own).when(~right_size, F.least(own, F.when(own.isNotNull(), 0.3))).when(inn_valid(raw), F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(0.95))).otherwise(F.coalesce(own * 0.5, F.lit(0.3)))
    raw, own = path(record, "vehicle.plate"), at("vehicle.plate")
    rules["vehicle.plate"] = F.when(raw.isNull(), own).when(plate(raw).isNotNull(), F.greatest(F.coalesce(own, F.lit(0.9)), F.lit(0.9))).otherwise(F.when(own.isNotNull(), F.least(own, F.lit(0.4))))
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"))) for k, v in rules.items()]))
    rest = F.map_filter(base, lambda k, _: ~k.isin(*rules))
    return F.transform_values(F.map_concat(rest, F.map_from_entries(entries)), lambda _, v: F.floor(v * 100 + 0.5) / 100)


def audit_diff(before: Column, after: Column) -> Column:
    """Entries (from, to) of the keys whose values differ, null where nothing does."""
    none = F.expr("CAST(map() AS map<string,string>)")
    both = F.map_zip_with(F.coalesce(before, none), F.coalesce(after, none), lambda _, a, b: F.struct(a.alias("from"), b.alias("to")))
    changed = F.map_filter(both, lambda _, v: ~v["from"].eqNullSafe(v["to"]))
    return F.when(F.size(F.map_keys(changed)) > 0, changed)


def append_issue(issues: Column, issue: Column, status: Column) -> Column:
    """The issues with one more, for finished jobs only; the array is made where there is none."""
    return F.when(status.isin("done", "needs_review"), F.array_append(F.coalesce(issues, F.expr(NO_TEXT)), issue)).otherwise(issues)


def transport_hint(record: Column) -> Column:
    at = lambda p: filled(path(record, p))
    return F.when(at("order_ref") | at("permit_no") | at("vehicle.plate") | (at("route_from") & at("route_to")), "Transportation")


def scrub_metadata(record: Column) -> Column:
    """Values under secret keys, and values that look like keys of known services, redacted."""
    key = lambda k: F.substring_index(k, ".", -1)
    return F.transform_values(record, lambda k, v: F.when(v.isNull(), v).when(key(k).rlike(SECRET_KEYS), F.concat(F.lit("[REDACTED: key="), key(k), F.lit("]"))).when(v.rlike(SECRET_VALUES), F.lit("[REDACTED: secret]")).otherwise(v))


def redact_fields(record: Column) -> Column:
    """Personal fields redacted whole, all other values by the patterns."""
    return F.transform_values(record, lambda k, v: F.when(k.isin(*PERSONAL) & v.isNotNull(), F.lit(tx.REDACTED)).otherwise(tx.redact(v)))


def scrub_passports(text: Column) -> Column:
    """Passport and machine-readable patterns alone."""
    return tx.redact(text, ("passport_rf", "mrz_line1", "mrz_line2", "passport_foreign", "personal_code_lv"))


def reasoning_bleed(raw: Column) -> Column:
    """A model's answer that thinks aloud for 40 characters or more before its first brace."""
    at = F.instr(raw, "{")
    prefix = F.lower(F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(raw))
    return (F.length(prefix) >= 40) & prefix.rlike("(?iu)" + BLEED)


def salvage_json(text: Column) -> Column:
    """The object between the first and the last brace, null if that is no JSON object."""
    start, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    body = F.when((start > 0) & (F.instr(text, "}") > 0) & (end > start), F.substring(text, start, end - start + 1))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def quality(n_fields: Column, n_expected: Column, n_missing: Column, confidence: Column, response: Column, ocr: Column) -> Column:
    """score, factors (names) and again (1 or more: try once more) of an extraction."""
    marks = (
        ("empty_extract", 1.5, n_fields == 0),
        ("confident_sparse", 0.6, (n_expected >= 4) & (n_fields > 0) & (confidence >= 0.8) & (n_missing > n_expected * 0.7)),
        ("truncated_json", 1.0, tx.truncated_json(response)),
        ("reasoning_bleed", 1.0, reasoning_bleed(response)),
        ("garbled_ocr", 0.7, tx.garbled_ratio(ocr) > 0.15),
    )
    score = sum((F.when(on, F.lit(w)).otherwise(0.0) for _, w, on in marks), F.lit(0.0))
    return F.struct(score.alias("score"), F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, _, on in marks])).alias("factors"), (score >= 1.0).alias("again"))


def _flag(x: Column | bool) -> Column:
    return F.lit(x) if isinstance(x, bool) else x


def decide_status(n_issues: Column, low_confidence: Column, n_fields: Column, doc_type: Column, class_confidence: Column, hinted: Column, deferred: Column, review_below: float = 0.5, skipped: Column | bool = False, checked: Column | bool = False) -> Column:
    """done or needs_review: any issue, low confidence, no fields, an unsure type or a deferral sends a job to review. No fields
    do so only where extraction wasn't skipped and its quality wasn't checked, which would have made it an issue."""
    unsure = ~hinted & (doc_type.isNull() | (F.coalesce(class_confidence, F.lit(1.0)) < review_below))
    return F.when(deferred | low_confidence | (n_issues > 0) | ((n_fields == 0) & ~_flag(skipped) & ~_flag(checked)) | unsure, "needs_review").otherwise("done")


def token_units(prompt: Column, output: Column) -> Column:
    """Both token counts together, null only if neither is known."""
    return F.when(prompt.isNotNull() | output.isNotNull(), F.coalesce(prompt, F.lit(0)) + F.coalesce(output, F.lit(0)))


def expand_references(value: Column, raw: Column, header: str = "Словарь повторов") -> Column:
    """``@12`` tokens of a value in the words of the text's legend (lines ``@12 = words`` under its header); tokens that it
    lacks stay."""
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^@[0-9]+ = .+$"))
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^(@[0-9]+) = (.+)$", 1).alias("key"), F.trim(F.regexp_extract(x, "^(@[0-9]+) = (.+)$", 2)).alias("value")))
    legend = F.map_from_entries(F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])) == 0))
    tokens = F.regexp_extract_all(value, F.lit("@[0-9]+"), F.lit(0))
    between = F.split(value, "@[0-9]+", -1)
    words = F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.try_element_at(legend, F.get(tokens, i)), F.get(tokens, i), F.lit(""))))
    return F.when(F.contains(raw, F.lit(header)) & F.contains(value, F.lit("@")), F.array_join(words, "")).otherwise(value)


def pick_name_field(fields: Sequence[str]) -> str | None:
    """The first field with the first of the name tokens; schemas are driver-side lists."""
    import re

    tokens = lambda f: [t.lower() for t in re.split("[^A-Za-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", f)) if t]
    return next((f for token in ("name", "description", "title", "goods", "product") for f in fields if token in tokens(f)), None)


def schema_leaves(schema: dict | None) -> int:
    """Leaf fields of a JSON schema: nested objects and arrays of objects count theirs, one at least, six levels deep."""

    def count(node: object, depth: int) -> int:
        if not isinstance(node, dict) or depth >= 6:
            return 1
        inner = node.get("properties") or (node.get("items") or {}).get("properties") if isinstance(node.get("items"), dict) or node.get("properties") else None
        return max(1, sum(count(d, depth + 1) for d in inner.values())) if isinstance(inner, dict) else 1

    props = (schema or {}).get("properties")
    return sum(count(d, 0) for d in props.values()) if isinstance(props, dict) else 0


def strip_party(place: Column, party: Column) -> Column:
    """A place without the name of a party that stands in it (with or without its legal form) and without what is left at
    the edges; the place itself if nothing meaningful would be left."""
    form = r"^(?:(?:ООО|АО|ЗАО|ОАО|ПАО|НАО|ИП|LLC|Ltd|GmbH|SIA|UAB)\.?\s+)+"
    bare = F.trim(F.regexp_replace(F.regexp_replace(party, "[«»\"“”']", ""), "(?iu)" + form, ""))
    clean = F.regexp_replace(place, "[«»\"“”']", "")
    at = F.instr(F.lower(clean), F.lower(bare))
    rest = F.concat(F.substring(clean, F.lit(1), at - 1), F.lit(" "), F.substring(clean, at + F.length(bare), F.lit(1 << 30)))
    edges = lambda x: F.regexp_replace(x, r"(?U)^[\s,;:.\-–—]+|[\s,;:\-–—]+$", "")
    left = F.regexp_replace(edges(F.regexp_replace(edges(rest), "(?iu)" + form, "")), r"(?iuU)[\s,]+(?:ООО|АО|ЗАО|ОАО|ПАО|НАО|ИП|LLC|SIA|UAB)$", "")
    left = F.regexp_replace(left, r"(?iuU)^(?:ООО|АО|ЗАО|ОАО|ПАО|НАО|ИП|LLC|SIA|UAB)[\s,]+", "")
    left = F.regexp_replace(edges(left), r"(?U)\s+", " ")
    return F.when((F.length(bare) >= 3) & (at > 0) & (F.length(left) >= 3), left).otherwise(place)
