"""Signed delivery whose attempts, waits and dead letters live in the state store and outlast restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from .jobs import signed

#: Rows that the delivery gives: one for each attempt.
OUTCOMES = "id string, attempt int, status int, outcome string"
_STATE = "payload string, attempt int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcome(status: int, attempt: int, attempts: int) -> str:
    """``delivered`` (2xx), ``refused`` (4xx but 408 and 429: the receiver won't take it), ``dead`` after the last attempt, else
    ``waiting``. A status of 0 stands for a receiver that wasn't reached."""
    if 200 <= status < 300:
        return "delivered"
    if 400 <= status < 500 and status not in (408, 429):
        return "refused"
    return "dead" if attempt >= attempts else "waiting"


class Delivery(StatefulProcessor):
    """One delivery for each id: a payload is sent at once and, while the receiver fails, again when its timer expires, after
    waits that double up to a minute. No task sleeps, and a receiver that is down holds up nothing but its own payloads.
    A newer payload of an id that waits takes the place of the older one and keeps its attempts."""

    def __init__(self, send: Callable[[str, str, int], int], secret: str, attempts: int, first_wait: float):
        self.send, self.secret, self.attempts, self.first_wait = send, secret, attempts, first_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def _try(self, key: str, payload: str, attempt: int, now: int) -> Row:
        try:
            status = self.send(payload, signed(payload.encode(), self.secret), attempt)
        except OSError:
            status = 0
        result = outcome(status, attempt, self.attempts)
        if result == "waiting":
            self.held.update((payload, attempt))
            self.handle.registerTimer(now + int(1000 * min(60.0, self.first_wait * 2 ** (attempt - 1))))
        else:
            self.held.clear()
        return Row(id=key, attempt=attempt, status=status, outcome=result)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = list(rows)[-1]["payload"]
        if key[0] is None:  # a beat
            return
        if self.held.exists():  # its timer is set
            self.held.update((last, self.held.get()[1]))
            return
        yield self._try(key[0], last, 1, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.held.exists():
            payload, attempt = self.held.get()
            yield self._try(key[0], payload, attempt + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Timers and states of this kind need the RocksDB store; a query keeps the one that it began with."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def deliver_with_retries(
    stream: DataFrame, send: Callable[[str, str, int], int], secret: str, checkpoint: str, sink: Callable[[DataFrame, int], None], attempts: int = 5, first_wait: float = 1.0, every: str = "1 second"
) -> StreamingQuery:
    """Deliver the rows (id, payload) of a stream from the executors; ``sink`` gets each micro-batch of ``OUTCOMES``, dead letters
    included. ``send(payload, signature, attempt)`` returns the receiver's HTTP status.

    Attempts are at least once: a task that is lost between a sending and its commit sends again under the same id and
    attempt number, which receivers may know by. Ids are spread over the shuffle partitions; state holds only payloads that wait.
    A beat each second, a row without id, keeps batches coming, so that timers expire without new rows and after a restart;
    rows of the stream without id are passed over like it."""
    spark = stream.sparkSession
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(None).cast("string").alias("id"), F.lit("").alias("payload"))
    with _rocks(spark):
        out = stream.select("id", "payload").unionByName(beat).groupBy("id").transformWithState(Delivery(send, secret, attempts, first_wait), OUTCOMES, "Update", "ProcessingTime")
        return out.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
