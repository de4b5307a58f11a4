"""Costs of jobs under providers' rates, and exchange rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round

RATES = "provider string, currency string, basis string, input_1k double, output_1k double, page double, table_page double"


def breakdown(jobs: DataFrame, rates: DataFrame, usd: float | None, fallback: dict[str, float] | None = None) -> DataFrame:
    """id, total (roubles), estimate, reasons of jobs (id, model, prompt, output, unknown_calls, ocr, pages, tables).

    Tokens cost their provider's rate for a thousand, pages of a cloud OCR engine (column ocr, null for local ones) that for
    a page or a table page. Each line is rounded to a hundredth; free providers cost nothing. A provider without rates, or
    without one of them, is charged the fallback's; that, calls without counts, cloud pages that aren't counted and a
    currency without rate make the total an estimate. Rates are a small table, a row for each provider."""
    fallback = fallback or {"input_1k": 1.0, "output_1k": 3.0, "page": 1.5, "table_page": 2.5}
    side = lambda p: F.broadcast(rates.select([F.col(c).alias(f"{p}_{c}") for c in rates.columns] + [F.lit(True).alias(f"{p}_known")]))  # noqa: E731  a row for each provider
    t = jobs.join(side("m"), F.col("model") == F.col("m_provider"), "left").join(side("o"), F.col("ocr") == F.col("o_provider"), "left")

    def line(p: str, on: Column, quantity: Column, rate: str) -> tuple[Column, Column]:
        own = F.coalesce(F.col(f"{p}_{rate}"), F.lit(fallback[rate]))
        dollars = F.coalesce(F.col(f"{p}_currency"), F.lit("RUB")) == "USD"
        paid = F.coalesce(on, F.lit(False)) & (quantity > 0) & (F.coalesce(F.col(f"{p}_basis"), F.lit("vendor")) != "free")
        each = F.when(dollars, F.lit(usd)).otherwise(1.0)
        return F.when(paid & each.isNotNull(), js_round(quantity * own * each, 2)).otherwise(0.0), paid & each.isNull()

    used = (F.col("prompt") > 0) | (F.col("output") > 0)
    parts = [line("m", used, F.col("prompt") / 1000, "input_1k"), line("m", used, F.col("output") / 1000, "output_1k")]
    cloud = F.col("ocr").isNotNull()
    parts += [line("o", cloud & ~F.col("tables"), F.col("pages"), "page"), line("o", cloud & F.col("tables"), F.col("pages"), "table_page")]
    reasons = (
        ("no rates of the model's provider", used & F.col("m_known").isNull()),
        ("no rates of the OCR provider", cloud & F.col("o_known").isNull()),
        ("calls without token counts", used & (F.col("unknown_calls") > 0)),
        ("cloud pages aren't counted", cloud & ~F.coalesce(F.col("pages") > 0, F.lit(False))),
        ("no exchange rate", parts[0][1] | parts[1][1] | parts[2][1] | parts[3][1]),
    )
    why = F.array_compact(F.array(*[F.when(on, F.lit(r)) for r, on in reasons]))
    return t.select("id", sum((p for p, _ in parts), F.lit(0.0)).alias("total"), (F.size(why) > 0).alias("estimate"), why.alias("reasons"))


def simple_cost(prompt: Column, output: Column, input_1k: float, output_1k: float) -> Column:
    return js_round(prompt / 1000 * input_1k + output / 1000 * output_1k, 2)


def resolve_rates(wanted: DataFrame, daily: DataFrame, config: dict[str, float]) -> DataFrame:
    """code, rate and source of the wanted codes: the daily feed's positive rate, else the configured one, else none."""
    feed = daily.where("rate > 0").select(F.col("code"), F.col("rate").alias("fed"), F.col("day"))
    own = F.create_map(*[F.lit(v) for pair in config.items() for v in pair])
    t = wanted.select(F.upper("code").alias("code")).join(feed, "code", "left").withColumn("set", F.try_element_at(own, F.col("code")))
    source = F.when(F.col("fed").isNotNull(), F.concat(F.lit("bank:"), F.col("day").cast("string"))).when(F.col("set") > 0, "config").otherwise("none")
    return t.select("code", F.coalesce("fed", F.when(F.col("set") > 0, F.col("set"))).alias("rate"), source.alias("source"))
