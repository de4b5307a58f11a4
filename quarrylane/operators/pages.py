"""Composite files: what a page says of itself, where documents start, and segments by an ordered fold over pages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HEAD = 600
# Headings that start a document, in the order they are tried, over folded text.
STARTS = (
    ("driver_passport", r"P<[A-Z]{3}|\bPASSPORT\b|ПАШПАРТ|РЭСПУБЛ[IІ]?КА|IDENTITY CARD"),
    ("excise_ead", r"АКЦИЗЕ ПРЕЦЕС|AKCIZES PRECES|684/2009|EXCISE MOVEMENT"),
    ("customs_export_ead", r"AUSFUHRBEGLEITDOKUMENT|EKSPORTA DEKLARACIJA|EXPORT ACCOMPANYING|EUROPAISCHE GEMEINSCHAFT|EUROPEAN COMMUNITY"),
    ("packing_list", r"PACKING LIST|УПАКОВОЧНЫЙ ЛИСТ|PACKLISTE|LISTA DE EMBALAJE"),
    ("cmr", r"\bCMR\b|МЕЖДУНАРОДНАЯ.{0,25}НАКЛАДНАЯ|FRACHTBRIEF|TOVARNI LIST"),
    ("vehicle_registration", r"REGISTRACIJOS LIUDIJIMAS|ТЕХНИЧЕСКИЙ ТАЛОН|TRANSPORDIAMET|CERTIFICAT D'IMMATRICULATION|\bTIR\b|CARNET TIR|СЕРТИФИКАТ ОДОБРЕНИЯ|CERTIFICATE OF APPROVAL"),
    ("transport_permit", r"ENGEDELY|РАЗОВОЕ РАЗРЕШЕНИ|SPECIAL SINGLE-TRIP|SINGLE TRIP PERMIT"),
    ("contract_specification", r"СПЕЦИФИКАЦИЯ.{0,25}КОНТРАКТ|SPECIFICATION.{0,25}CONTRACT|SPEZIFIKATION|ESPECIFICACION"),
    ("certificate_register", r"РЕЕСТР.{0,25}СЕРТИФИКАТ|ANNEX TO INVOICE|СЕРТИФИКАТ СООТВЕТСТВИЯ ЕАЭС|ПЕРЕЧЕНЬ СЕРТИФИКАТОВ"),
    ("delivery_note", r"DELIVERY NOTE|РАСХОДНАЯ НАКЛАДНАЯ|LIEFERSCHEIN|PAVADZIME|ОТГРУЗОЧНАЯ НАКЛАДНАЯ"),
)
INVOICE = r"\bINVOICE\b|\bFACTURA\b|\bRECHNUNG\b|\bFACTURE\b|\bREKINS\b|ИНВОЙС|КОММЕРЧЕСКИЙ СЧЕТ|СЧЕТ-ФАКТУРА"
IDENTITY = {
    "mrn": r"\bMRN\b[^A-Z0-9]{0,40}([0-9]{2}[A-Z]{2}[A-Z0-9]{13,17})",
    "arc": r"\bARC\b[^A-Z0-9]{0,20}([0-9]{2}[A-Z]{2}[A-Z0-9]{15,19})",
    "invoice_no": r"(?:INVOICE\s*(?:NO|NUMBER|#)|FACTURA|REKINS|RECHNUNG(?:\s*NR)?|FACTURE|СЧЕТ[- ]?ФАКТУРА\s*№?)[^A-Z0-9]{0,8}([A-Z0-9][A-Z0-9/._-]{1,20})",
}


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks (U+0300 to U+036F), in capitals; Spark has no such built-in."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ").upper())


def identity(folded: Column) -> Column:
    """mrn, arc and invoice_no of a folded page head; null where they aren't named."""
    return F.struct(*[F.nullif(F.regexp_extract(folded, p, 1), F.lit("")).alias(n) for n, p in IDENTITY.items()])


def start(folded: Column) -> Column:
    """The type whose heading a folded page head has, before anything is known of the pages ahead. An export declaration
    needs its reference number. Last comes the invoice."""
    out = F.when(folded.rlike(INVOICE), "commercial_invoice")
    for slug, pattern in reversed(STARTS):
        on = folded.rlike(pattern)
        out = F.when(on & (F.regexp_extract(folded, IDENTITY["mrn"], 1) != "") if slug == "customs_export_ead" else on, slug).otherwise(out)
    return out


def page_heads(pages: DataFrame) -> DataFrame:
    """Pages (file, page, text, type, confidence) with ``start`` and ``identity`` of their first 600 characters."""
    t = pages.withColumn("folded", fold(F.substring("text", 1, HEAD)))
    return t.withColumn("start", start(F.col("folded"))).withColumn("identity", identity(F.col("folded"))).drop("folded")


def conflict(a: Column, b: Column) -> Column:
    """Whether two identities name different invoices or different declarations."""
    differ = lambda n: F.coalesce(a[n] != b[n], F.lit(False))
    return differ("invoice_no") | differ("mrn")


_ID = "struct<mrn:string,arc:string,invoice_no:string>"
_SEGMENT = f"struct<type:string,first:int,last:int,confidence:double,bounded:boolean,identity:{_ID}>"


def split_pages(pages: DataFrame, least_chars: int = 100, least_confidence: float = 0.4, floor: float = 0.6) -> DataFrame:
    """file, segment, type, first, last, confidence, bounded, pages of pages with heads (file, page, n_chars, type,
    confidence, start, identity).

    A page with a heading starts a segment (of ``floor`` confidence or more), unless it goes on the same declaration or
    invoice (a page whose optional ``forced`` is true starts one all the same); so does one whose identity conflicts with the segment's. Any other page joins the segment if it is short or
    unsure, has no type or the same one, or the segment began with a heading. A segment's confidence is the running mean
    of its pages, to which weak ones add nothing new; it takes over the first identity it meets. The fold reads a file's
    pages in order from one array: a file's pages are as many as one document holds."""
    row = F.struct(F.col("page").cast("int").alias("page"), "n_chars", "type", F.col("confidence").cast("double").alias("confidence"), "start", "identity", (F.coalesce("forced", F.lit(False)) if "forced" in pages.columns else F.lit(False)).alias("forced"))
    files = pages.groupBy("file").agg(F.array_sort(F.collect_list(row)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        now = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce(x["identity"]["mrn"] == now["identity"]["mrn"], F.lit(False)) & (x["start"] == "customs_export_ead")
        same = same | (F.coalesce(x["identity"]["invoice_no"] == now["identity"]["invoice_no"], F.lit(False)) & (x["start"] == "commercial_invoice"))
        bounded = x["start"].isNotNull() & (x["forced"] | ~F.coalesce(same, F.lit(False)))
        new = F.struct(F.when(bounded, x["start"]).otherwise(x["type"]).alias("type"), x["page"].alias("first"), x["page"].alias("last"), F.when(bounded, F.greatest(x["confidence"], F.lit(floor))).otherwise(x["confidence"]).alias("confidence"), bounded.alias("bounded"), x["identity"].alias("identity")).cast(_SEGMENT)
        weak = (x["n_chars"] < least_chars) | (x["confidence"] < least_confidence)
        joins = weak | x["type"].isNull() | F.coalesce(x["type"] == now["type"], F.lit(False)) | now["bounded"]
        n = x["page"] - now["first"] + 1
        mean = (now["confidence"] * (n - 1) + F.when(weak, now["confidence"]).otherwise(x["confidence"])) / n
        known = F.coalesce(now["identity"]["mrn"], now["identity"]["arc"], now["identity"]["invoice_no"]).isNotNull()
        longer = F.struct(now["type"].alias("type"), now["first"].alias("first"), x["page"].alias("last"), mean.alias("confidence"), now["bounded"].alias("bounded"), F.when(known, now["identity"]).otherwise(x["identity"]).alias("identity")).cast(_SEGMENT)
        opens = (F.size(acc) == 0) | bounded | conflict(x["identity"], now["identity"]) | ~joins
        return F.when(opens, F.array_append(acc, new)).otherwise(F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer))

    folded = F.aggregate("p", F.expr(f"CAST(array() AS array<{_SEGMENT}>)"), step)
    s = files.select("file", F.posexplode(folded).alias("i", "s")).select("file", (F.col("i") + 1).alias("segment"), "s.*")
    span = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    return s.withColumn("confidence", F.floor(F.col("confidence") * 1000 + 0.5) / 1000).withColumn("pages", span)


def several_documents(segments: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """file, several: two segments or more, of which one is typed: by a heading, or with ``least_confidence`` or more."""
    typed = F.count_if(F.col("bounded") | (F.col("type").isNotNull() & (F.col("confidence") >= least_confidence)))
    return segments.groupBy("file").agg(((F.count("*") >= 2) & (typed >= 1)).alias("several"))


def weak_pages(pages: DataFrame, least_confidence: float = 0.5, scant: int = 120) -> DataFrame:
    """Pages behind a file's first whose words give no type or an unsure one, with ``scant``: whether their text is too
    short to ask for its type by text."""
    weak = F.col("type").isNull() | (F.col("confidence") < least_confidence)
    return pages.where(weak & (F.col("page") > 1)).withColumn("scant", F.col("n_chars") < scant)


def overridden(pages: DataFrame, by_image: DataFrame | None = None, by_text: DataFrame | None = None, floor: float = 0.6) -> DataFrame:
    """Pages with the types that models (tables of file, page and type) gave the weak ones, each the start of a segment: by
    image for pages of scant text, else by text, and by image if the text gave none. Without a table of images scant pages
    are asked by text."""
    t = weak_pages(pages).select("file", "page", "scant")
    for name, table in (("_image", by_image), ("_text", by_text)):
        one = None if table is None else table.groupBy("file", "page").agg(F.min("type").alias(name))
        t = t.withColumn(name, F.lit(None).cast("string")) if one is None else t.join(one, ["file", "page"], "left")
    found = F.coalesce("_text", "_image") if by_image is None else F.when(F.col("scant"), F.col("_image")).otherwise(F.coalesce("_text", "_image"))
    t = t.select("file", "page", F.nullif(found, F.lit("")).alias("_given")).where("_given IS NOT NULL")
    out = pages.join(t, ["file", "page"], "left").withColumn("forced", F.col("_given").isNotNull())
    return out.withColumns({"type": F.coalesce("_given", "type"), "start": F.coalesce("_given", "start"), "confidence": F.when(F.col("forced"), F.greatest("confidence", F.lit(floor))).otherwise(F.col("confidence"))}).drop("_given")


def segment_texts(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """The segments with ``text``: the texts of their pages, a blank line between them."""
    at = segments.select("file", "segment", F.explode(F.sequence("first", "last")).alias("page"))
    texts = at.join(pages.select("file", F.col("page").cast("int").alias("page"), "text"), ["file", "page"], "left")
    whole = texts.groupBy("file", "segment").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("_t"))
    return segments.join(whole, ["file", "segment"]).withColumn("text", F.array_join(F.transform("_t", lambda x: x["text"]), "\n\n")).drop("_t")


def run_documents(pages: DataFrame, by_image: DataFrame | None = None, by_text: DataFrame | None = None) -> DataFrame:
    """The documents of composite files: pages (file, page, n_chars, text, type, confidence, start, identity) whose weak types
    models may override are split again into segments, and typed segments of files that hold several documents are returned
    with their text."""
    segments = split_pages(overridden(pages, by_image, by_text))
    several = several_documents(segments).where("several").select("file")
    return segment_texts(segments.where("type IS NOT NULL").join(several, "file", "left_semi"), pages)
