"""Deliveries to receivers that fail, refuse and recover, across a restart."""

from __future__ import annotations

import json
import time
from pathlib import Path

from quarrylane.streaming.delivery import deliver_with_retries, outcome
from quarrylane.streaming.jobs import signed


def test_outcomes():
    assert [outcome(*x, 3) for x in ((204, 1), (400, 1), (429, 1), (500, 2), (0, 3), (503, 3), (404, 3))] == ["delivered", "refused", "waiting", "waiting", "dead", "dead", "refused"]


def test_delivery_outlasts_a_restart(spark, tmp_path):
    log, source = tmp_path / "log", tmp_path / "in"
    log.mkdir()
    rows = [("a", '{"n":1}'), ("b", '{"n":2}'), ("c", '{"n":3}'), ("d", '{"n":4}')]
    schema = "id string, payload string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))

    def send(payload: str, signature: str, attempt: int) -> int:
        """a takes it, b from the third attempt on (the first two don't reach it), c refuses, d is always down."""
        n = json.loads(payload)["n"]
        Path(log, f"{n}-{attempt}").write_text(signature)
        if n == 2 and attempt < 3:
            raise ConnectionError
        return {1: 200, 2: 200, 3: 410, 4: 503}[n]

    got: list[tuple] = []

    def run(until) -> None:
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = deliver_with_retries(stream, send, "key", str(tmp_path / "ck"), lambda df, _: got.extend(tuple(r) for r in df.collect()), attempts=4, first_wait=0.5, every="200 milliseconds")
        ends = time.time() + 90
        while not until() and time.time() < ends and query.isActive:
            time.sleep(0.2)
        query.stop()
        assert query.exception() is None and until(), got

    run(lambda: len(got) >= 4)
    run(lambda: {(r[0], r[3]) for r in got} >= {("a", "delivered"), ("b", "delivered"), ("c", "refused"), ("d", "dead")})
    last = {}
    for id_, attempt, status, result in got:
        last[id_] = max(last.get(id_, (0,)), (attempt, status, result))
    assert last == {"a": (1, 200, "delivered"), "b": (3, 200, "delivered"), "c": (1, 410, "refused"), "d": (4, 503, "dead")}
    assert {p.name for p in log.iterdir()} == {"1-1", "2-1", "2-2", "2-3", "3-1", "4-1", "4-2", "4-3", "4-4"}
    assert all(p.read_text() == signed(dict(zip("1234", (r[1] for r in rows), strict=True))[p.name[0]].encode(), "key") for p in log.iterdir())
