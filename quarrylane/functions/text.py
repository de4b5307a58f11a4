"""Text cleaning, scoring and redaction as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that must match what users of the service match today.
REFUSAL_PATTERNS = (
    r"извините,?\s+я\s+не\s+могу\s+просматривать\s+изображения",
    r"я\s+не\s+могу\s+просматривать\s+изображения",
    r"я\s+не\s+могу\s+видеть\s+изображени",
    r"я\s+не\s+могу\s+прочитать\s+изображени",
    r"я\s+не\s+могу\s+обработать\s+изображени",
    r"я\s+не\s+могу\s+проанализировать\s+изображени",
    r"я\s+не\s+вижу\s+(?:никакого\s+)?(?:изображения|картинки|документа)",
    r"у\s+меня\s+нет\s+возможности\s+(?:просматривать|видеть)",
    r"пожалуйста,?\s+(?:скопируйте|вставьте)\s+(?:текст|содержимое)",
    r"i\s+(?:cannot|can'?t|am\s+unable\s+to)\s+(?:view|see|read|process|analyze)\s+(?:images?|pictures?|attachments?)",
    r"i\s+don'?t\s+(?:have\s+the\s+ability|see)\s+(?:to\s+(?:view|see|process)|any\s+image)",
    r"sorry,?\s+i\s+(?:cannot|can'?t|am\s+unable)",
    r"i\s+(?:am\s+)?unable\s+to\s+(?:view|see|process|read)",
    r"(?:please|kindly)\s+(?:copy|paste|provide)\s+(?:the\s+)?text",
    r"我\s*无法\s*查看\s*图(?:像|片)",
    r"抱歉.{0,20}无法\s*(?:查看|处理|分析)",
)
REDACTED = "[REDACTED]"
# Personal-data patterns in the order they apply, with what replaces a match.
PII_PATTERNS = (
    ("passport_rf", r"(?iu)(паспорт|серия)[^\d\n]{0,15}\d{2}\s?\d{2}\s?№?\s?\d{6}(?![0-9A-Za-z_])", "$1 [REDACTED]"),
    ("driver_license", r"(?iu)(вод(\.|ительск)?(\s|\.)*удост\w*)[^\d\n]{0,15}[А-ЯA-Z\d]{2}\s?[А-ЯA-Z\d]{2}\s?\d{6}(?![0-9A-Za-z_])", "$1 [REDACTED]"),
    ("mrz_line1", r"P<[A-Z]{3}[A-Z0-9<]{5,}", REDACTED),
    ("mrz_line2", r"[A-Z0-9<]{9}\d[A-Z]{3}\d{6}\d[MFX<]\d{6}\d[A-Z0-9<]{2,}", REDACTED),
    ("passport_foreign", r"(?iu)((?:passport|pass\.|паспорт)[^\d\n]{0,15})([A-Z]{0,2}\s?\d{6,9})(?![0-9A-Za-z_])", "$1[REDACTED]"),
    ("personal_code_lv", r"(?<![0-9A-Za-z_])\d{6}-\d{5}(?![0-9A-Za-z_])", REDACTED),
    ("personal_code_ctx", r"(?iu)((?:asmens\s+kodas|isikukood|personal\s+(?:code|number)|персональн\w*\s+(?:код|номер)|личн\w*\s+номер)[^\d\n]{0,10})(\d{6,11})(?![0-9A-Za-z_])", "$1[REDACTED]"),
    ("phone_ru", r"(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}", REDACTED),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", REDACTED),
)


def strip_control(text: Column) -> Column:
    """Without control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def js_round(x: Column, digits: int) -> Column:
    """Half up, towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def one_case(text: Column) -> Column:
    """A text in one case, where what a pattern that ignores case takes for the same ASCII or Cyrillic letter is the same."""
    # The small form of \u0130 is two characters; and Spark takes small(large(x)) for small(x), which leaves \u017f as it is.
    return F.lower(F.replace(F.upper(text), F.lit("\u0130"), F.lit("I")))


def decode_entities(text: Column) -> Column:
    """Named and numeric entities, the ampersand last, so nothing is decoded twice. Numbers that are no code points go."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        text = F.replace(text, F.lit(name), F.lit(char))
    numeric = "&#([0-9]+|x[0-9a-fA-F]+);"

    def character(code: Column) -> Column:
        hexa = F.startswith(code, F.lit("x"))
        n = F.when(F.length(code) > 8, F.lit(-1)).otherwise(F.when(hexa, F.conv(F.substring(code, 2, 8), 16, 10)).otherwise(code).cast("long"))
        utf32 = F.lpad(F.hex(n), 8, "0")
        return F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(utf32), "UTF-32")).otherwise("")

    def numbers(t: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(t, F.lit(numeric), F.lit(1)), character)
        parts = F.zip_with(F.split(t, numeric, -1), codes, lambda part, c: F.concat(part, F.coalesce(c, F.lit(""))))
        return F.when(F.contains(t, F.lit("&#")), F.array_join(parts, "")).otherwise(t)

    return F.replace(let(text, numbers), F.lit("&amp;"), F.lit("&"))


def _table_to_markdown(body: Column) -> Column:
    """The rows of a table's inner HTML as a Markdown table: the first is the header, all are padded to the widest."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", " "), r"(?i)</(p|div|li|tr)>", " "), "<[^>]+>", "")
    cell = lambda x: F.replace(F.trim(F.regexp_replace(decode_entities(plain(x)), r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))
    rows = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), cell))

    def table(rows: Column, wide: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
        ruler = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
        # Behind the first line, the header, comes the ruler.
        return F.array_join(F.flatten(F.transform(rows, lambda r, i: F.when(i == 0, F.array(line(r), ruler)).otherwise(F.array(line(r))))), "\n")

    widest = lambda rows: F.array_max(F.transform(rows, lambda r: F.size(r)))
    made = let(F.filter(rows, lambda r: F.size(r) > 0), lambda rows: let(widest(rows), lambda wide: table(rows, wide)))
    return F.concat(F.lit("\n\n"), F.coalesce(made, F.lit("")), F.lit("\n\n"))


def tables_to_markdown(html: Column, depth: int = 3) -> Column:
    """HTML tables as Markdown, innermost first, ``depth`` levels deep."""
    inner = r"(?is)<table\b[^>]*>((?:(?!<table\b).)*?)</table>"

    def once(h: Column) -> Column:
        bodies = F.transform(F.regexp_extract_all(h, F.lit(inner), F.lit(1)), _table_to_markdown)
        parts = F.zip_with(F.split(h, inner, -1), bodies, lambda part, table: F.concat(part, F.coalesce(table, F.lit(""))))
        return F.when(h.rlike(inner), F.array_join(parts, "")).otherwise(h)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), html, lambda h, _: once(h))


def html_to_markdown(html: Column) -> Column:
    """Tables, headings, list items and line breaks of a page as Markdown; all other tags go."""
    t = F.regexp_replace(html, r"(?is)<img[^>]*>|<!--.*?-->", "")
    t = let(t, lambda x: F.when(x.rlike(r"(?i)<table\b"), tables_to_markdown(x)).otherwise(x))
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    t = F.regexp_replace(t, r"(?is)<li[^>]*>(.*?)</li>", "- $1\n")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>", "\n")
    t = decode_entities(F.regexp_replace(t, r"<[^>]+>", ""))
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def refusal_coverage(text: Column) -> Column:
    """Characters that refusal patterns match over the length of the text."""
    total = F.lit(0)
    for pattern in REFUSAL_PATTERNS:
        total = total + F.aggregate(F.regexp_extract_all(text, F.lit("(?iu)" + pattern), F.lit(0)), F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.length(text) > 0, total / F.length(text)).otherwise(F.lit(0.0))


def is_refusal(text: Column) -> Column:
    cover = refusal_coverage(text)
    return (cover > 0) & ((F.length(text) < 800) | (cover >= 0.3))


def pdf_text_quality(text: Column) -> Column:
    """0 to 1: how much a text layer looks like a document's text."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    russian = F.length(F.regexp_replace(t, "[^А-Яа-яЁё]", ""))
    density = letters / n
    score = F.when(letters > 200, 0.5).when(letters > 50, 0.3).otherwise(0.0) + F.when(density > 0.5, 0.3).when(density > 0.3, 0.15).otherwise(0.0)
    score = score + F.when(russian > 30, 0.15).otherwise(0.0) + F.when(t.rlike("(?iu)(ИНН|СЧЁТ|СЧЕТ|УПД|АКТ|НАКЛАДНАЯ|CMR|КПП|Итого|НДС)"), 0.1).otherwise(0.0)
    return F.when(n < 50, 0.0).otherwise(F.least(F.lit(1.0), score))


def combine_confidence(ocr: Column, parser: Column) -> Column:
    return F.when(parser.isNull(), ocr).when(parser <= 0, ocr * 0.85).otherwise(F.sqrt(F.greatest(F.lit(0.0), ocr) * parser))


def normalize_confidence(x: Column) -> Column:
    """A share between 0 and 1 from a share or a percentage; not a number is 0."""
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x))))


def garbled_ratio(text: Column) -> Column:
    """Share of the tokens of three characters or more that mix Latin and Cyrillic letters."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: F.length(t) >= 3)
    mixed = F.filter(tokens, lambda t: t.rlike("[A-Za-z]") & t.rlike("[А-Яа-яЁё]"))
    return F.when((F.length(text) < 50) | (F.size(tokens) == 0), 0.0).otherwise(F.size(mixed) / F.size(tokens))


def script_kind(text: Column) -> Column:
    latin, cyrillic = text.rlike("[A-Za-z]"), text.rlike("[А-Яа-яЁё]")
    return F.when(latin & cyrillic, "mixed").when(cyrillic, "cyrillic").when(latin, "latin")


def table_row_count(text: Column) -> Column:
    """Lines with two separators or more."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: (F.length(F.trim(x)) > 0) & (F.length(x) - F.length(F.regexp_replace(x, r"[,\t;|]", "")) >= 2)))


def truncated_json(text: Column) -> Column:
    opens, closes = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in "{}")
    return (opens > 0) & (closes < opens)


def chunks(text: Column, most_chars: int = 12_000, most_rows: int = 30) -> Column:
    """A text in chunks of whole lines: a chunk ends at ``most_rows`` table rows or ``most_chars`` characters (line ends
    included); a longer line is cut by itself. A fold over the lines of one text."""
    state = "struct<done:array<string>,held:array<string>,chars:int,rows:int>"
    none = F.expr("CAST(array() AS array<string>)")
    st = lambda d, h, c, r: F.struct(d.alias("done"), h.alias("held"), c.cast("int").alias("chars"), r.cast("int").alias("rows")).cast(state)
    flushed = lambda d, h: F.when(F.size(h) > 0, F.array_append(d, F.array_join(h, "\n"))).otherwise(d)
    is_row = lambda x: (F.length(F.trim(x)) > 0) & (F.length(x) - F.length(F.regexp_replace(x, r"[,\t;|]", "")) >= 2)

    def step(s: Column, x: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most_chars).cast("int")), lambda i: F.substring(x, i * most_chars + 1, F.lit(most_chars)))
        long_ = F.length(x) + 1 > most_chars
        held, size, rows = F.array_append(s["held"], x), s["chars"] + F.length(x) + 1, s["rows"] + is_row(x).cast("int")
        full = (rows >= most_rows) | (size >= most_chars)
        return F.when(long_, st(F.concat(flushed(s["done"], s["held"]), pieces), none, F.lit(0), F.lit(0))).when(full, st(flushed(s["done"], held), none, F.lit(0), F.lit(0))).otherwise(st(s["done"], held, size, rows))

    end = F.aggregate(F.split(text, "\n", -1), st(none, none, F.lit(0), F.lit(0)), step)
    return flushed(end["done"], end["held"])


def head_tail(text: Column, head: int = 4000, tail: int = 2000, marker: str = "\n...\n") -> Column:
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail))))


def redact(text: Column, names: tuple[str, ...] | None = None) -> Column:
    for name, pattern, replacement in PII_PATTERNS:
        if names is None or name in names:
            text = F.regexp_replace(text, pattern, replacement)
    return text


def field_tokens(name: Column) -> Column:
    """Lower-case words of a camel-case or separated field name."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda t: t != "")
