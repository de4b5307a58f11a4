"""Views that give the test tables the shapes operators take: jobs, usage log, items, reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Job status for each event type.
STATUS = {"purchase": "done", "view": "needs_review", "error": "failed", "click": "processing", "signup": "pending"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), F.col("event_type"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), status.alias("status"), F.col("value").alias("latency"), (F.col("value") / 1000).alias("confidence"),
        (F.col("user_id") % 7).cast("string").alias("doc_type"), F.when(F.col("user_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("e"), (F.col("user_id") % 3).cast("string"))).alias("engine"),
        F.col("user_id").alias("owner"), F.col("props").alias("extracted"), F.sha2(F.col("props").cast("binary"), 256).alias("sha"),
    )


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).alias("caller"), F.col("event_type").alias("connector"), F.when(F.col("event_id") % 9 == 0, "error").otherwise("success").alias("status"), F.col("value").alias("units"), F.col("ts").cast("timestamp").alias("started_at"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.floor(F.col("l_tax") * 100 + 0.5).cast("double").alias("rate"), F.col("l_extendedprice").alias("total"), F.col("l_partkey").alias("code"), F.col("l_discount").alias("discount"))


def part_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("display_name"), F.array(F.lower("p_name"), F.col("p_partkey").cast("string")).alias("keys"))
