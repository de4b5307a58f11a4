"""Totals of line items against document headers. Items: doc, line, qty, price, rate (percent), total; headers: doc, total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def line_total(total: str = "total"):
    """The explicit total, else quantity times price with tax."""
    return F.coalesce(F.col(total), F.col("qty") * F.col("price") * (1 + F.col("rate") / 100))


def recompute(headers: DataFrame, items: DataFrame, least_change: float = 1.0) -> DataFrame:
    """doc, stated, summed, total, delta: the sum of the lines replaces the stated total where every line has one and they
    differ by ``least_change`` or more."""
    sums = items.groupBy("doc").agg(F.sum(line_total()).alias("summed"), F.count_if(line_total().isNull()).alias("missing"), F.count("*").alias("lines"))
    t = headers.join(sums, "doc", "left")
    change = F.coalesce((F.col("missing") == 0) & (F.abs(F.col("summed") - F.col("stated")) >= least_change), F.lit(False))
    return t.select("doc", "stated", "summed", F.when(change, F.col("summed")).otherwise(F.col("stated")).alias("total"), F.when(change, F.col("summed") - F.col("stated")).alias("delta"))


def modal_rate(items: DataFrame) -> DataFrame:
    """doc, rate: the most frequent tax rate, of equals the higher."""
    n = items.where("rate IS NOT NULL").groupBy("doc", "rate").agg(F.count("*").alias("n"))
    return n.groupBy("doc").agg(F.max_by("rate", F.struct("n", "rate")).alias("rate"))


def inconsistent_lines(items: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Lines whose total is further than ``tolerance`` of it from quantity times price."""
    off = F.abs(F.col("qty") * F.col("price") - F.col("total"))
    return items.where(off > tolerance * F.abs("total")).select("doc", "line", off.alias("off"))


def vat_issues(documents: DataFrame) -> DataFrame:
    """Documents (doc, total, vat, rate) whose tax isn't total * rate / (100 + rate), within 1 or half a percent of the total."""
    due = F.col("total") * F.col("rate") / (100 + F.col("rate"))
    return documents.where(F.abs(F.col("vat") - due) > F.greatest(F.lit(1.0), 0.005 * F.col("total"))).select("doc", "vat", due.alias("due"))


def first_of_item(items: DataFrame, parts: list[str]) -> DataFrame:
    """Items without later repeats of the same key: its parts trimmed, lower-cased and joined; items without a key all stay."""
    key = F.concat_ws("|", *[F.nullif(F.lower(F.trim(F.col(p).cast("string"))), F.lit("")) for p in parts])
    t = items.withColumn("_key", key)
    order = Window.partitionBy("doc", "_key").orderBy("line")
    keyed = t.where("_key <> ''").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return keyed.unionByName(t.where("_key = ''")).drop("_key")


def derive_header(headers: DataFrame, items: DataFrame, rates: Sequence[float] = (0, 5, 7, 10, 18, 20, 22), near: float = 0.6) -> DataFrame:
    """Headers (doc, total, total_with_vat, net, vat, rate) with what follows from their own values, and ``derived``, the names
    of what was added: the total from that with tax, net and tax from each other, the rate from the lines' most frequent
    one, else from tax and net, snapped to one of ``rates`` within ``near``. A document without any total stays as it is."""
    t = headers.join(modal_rate(items).withColumnRenamed("rate", "_modal"), "doc", "left")
    gross = F.coalesce("total", "total_with_vat")
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    net = F.coalesce(F.col("net"), gross - F.col("vat"))
    implied = F.col("vat") / F.nullif(net, F.lit(0.0)) * 100
    snapped = F.coalesce(*[F.when(F.abs(implied - r) <= near, F.lit(float(r))) for r in rates], cents(implied))
    new = {
        "total": F.when(F.col("total").isNull(), cents(gross)), "net": F.when(F.col("net").isNull(), cents(gross - F.col("vat"))), "vat": F.when(F.col("vat").isNull(), cents(gross - F.col("net"))),
        "rate": F.when(F.col("rate").isNull() & gross.isNotNull(), F.coalesce(F.col("_modal").cast("double"), snapped)),
    }
    derived = F.array_compact(F.array(*[F.when(x.isNotNull(), F.lit(c)) for c, x in new.items()]))
    return t.select("doc", *[F.coalesce(F.col(c), x).alias(c) for c, x in new.items()], derived.alias("derived"))
