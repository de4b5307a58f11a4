from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.streaming.jobs import dedup_within, deliver


def test_dedup_and_delivery(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, key string").withColumn("ts", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sent = []
    deliver(dedup_within(stream, ["key"], "ts"), lambda df, i: sent.extend(r["payload"] for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert len(sent) == 2 and {'"key":"a"' in p for p in sent} == {True, False}
