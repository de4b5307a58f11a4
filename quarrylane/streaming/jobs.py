"""Streaming twins of the job operators, for any readStream source."""

from __future__ import annotations

import hashlib
import hmac
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def dedup_within(stream: DataFrame, keys: list[str], ts: str, ttl: str = "24 hours") -> DataFrame:
    """The first event of each key within ``ttl`` of event time; state is bounded by the watermark."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def status_counts(stream: DataFrame, ts: str, step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """bucket, status, n in epoch-aligned tumbling windows; a window is final once the watermark passes it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, step).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "status", "n")


def deliver(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch, as JSON payloads with its id, to ``send``; the checkpoint makes restarts pick up where they were."""
    def batch(df: DataFrame, batch_id: int) -> None:
        send(df.select(F.to_json(F.struct("*")).alias("payload")), batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signed(payload: bytes, secret: str) -> str:
    """HMAC-SHA256 of a payload, in hexadecimal, as receivers check it."""
    return hmac.new(secret.encode(), payload, hashlib.sha256).hexdigest()


def deliver_signed(stream: DataFrame, send: Callable[[str, str], bool], secret: str, checkpoint: str, attempts: int = 5, wait: Callable[[float], None] = time.sleep):
    """Deliver each row's JSON with its signature from the executors, trying again after 1, 2, 4, ... seconds (60 at most) up
    to ``attempts`` times. ``send`` says whether it arrived; a row that never does fails its batch, which the checkpoint
    repeats."""

    def one(rows: Iterator[Row]) -> None:
        for row in rows:
            for n in range(attempts):
                if send(row["payload"], signed(row["payload"].encode(), secret)):
                    break
                if n + 1 == attempts:
                    raise RuntimeError("not delivered")
                wait(min(60.0, 2.0**n))

    def batch(df: DataFrame, _: int) -> None:
        df.select(F.to_json(F.struct("*")).alias("payload")).foreachPartition(one)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
