"""Bounded-space online packing of documents' token ids into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]


class Packer:
    """Keeps ``windows`` open sequences. A piece goes where it leaves least room; when none has room, the fullest is
    topped up by a cut from the piece if ``least_cut`` ids or more are missing there, and emitted."""

    def __init__(self, length: int, windows: int, least_cut: int, emit: Callable[[list[tuple]], None]):
        self.length, self.windows, self.least_cut, self.emit = length, windows, least_cut, emit
        self.open: list[tuple[int, list[tuple]]] = []  # (ids in it, pieces)

    def add(self, doc: object, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        while n >= self.length:  # whole sequences of their own
            self.emit([(doc, start, ids[: 4 * self.length], total)])
            ids, start, n = ids[4 * self.length :], start + self.length, n - self.length
        if not n:
            return
        best = max((i for i, (used, _) in enumerate(self.open) if used + n <= self.length), key=lambda i: self.open[i][0], default=None)
        if best is not None:
            used, pieces = self.open[best]
            pieces.append((doc, start, ids, total))
            if used + n == self.length:
                self.emit(self.open.pop(best)[1])
            else:
                self.open[best] = (used + n, pieces)
        elif len(self.open) < self.windows:
            self.open.append((n, [(doc, start, ids, total)]))
        else:
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(fullest)
            room = self.length - used
            if room >= self.least_cut:  # n > room here
                pieces.append((doc, start, ids[: 4 * room], total))
                ids, start = ids[4 * room :], start + room
            self.emit(pieces)
            self.add(doc, start, ids, total)


def _rows(pieces: list[tuple], sequence: int | None, keep_ids: bool) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, total in pieces:
        n = len(ids) // 4
        out.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, ids if keep_ids else None))
        offset += n
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, [*_FIELDS, ("ids", pa.binary())], strict=True)], names=[*(n for n, _ in _FIELDS), "ids"])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, windows: int = 16, least_cut: int = 48, merge_rows: int = 20_000) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset.

    Each partition of the input is read once, in order, with ``windows`` open sequences; its documents never leave it.
    What is still open at a partition's end, at most ``windows`` sequences, is written with its ids and merged: about
    ``merge_rows`` leftover pieces go to one packer, which cuts freely, so that each merge task leaves at most one
    sequence unfilled. A null or empty text is the end id alone. Repeated rows are packed as often as they occur.
    An empty table gives no rows. Columns other than doc_id and text aren't read."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode_batch, np.array([end_id], "<u4").tobytes()
        base, count, rows = TaskContext.get().partitionId() << 32, 0, []

        def emit(pieces: list[tuple]) -> None:
            nonlocal count
            rows.extend(_rows(pieces, base + count, False))
            count += 1

        packer = Packer(length, windows, least_cut, emit)
        for batch in small_batches(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                packer.add(doc, 0, ids + end, len(ids) // 4 + 1)
            if len(rows) >= 5000:
                yield _batch(rows)
                rows.clear()
        for _, pieces in packer.open:
            rows.extend(_rows(pieces, None, True))
        yield _batch(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count, rows = (1 << 62) + (TaskContext.get().partitionId() << 32), 0, []

        def emit(pieces: list[tuple]) -> None:
            nonlocal count
            rows.extend(_rows(pieces, base + count, False))
            count += 1

        packer = Packer(length, 1, 1, emit)
        for batch in batches:
            for r in batch.to_pylist():
                packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
            if len(rows) >= 5000:
                yield _batch(rows)
                rows.clear()
        for _, pieces in packer.open:
            emit(pieces)
        yield _batch(rows)

    schema = f"{PIECE}, ids binary"
    done = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, schema), "packed")
    left = done.where("sequence_id IS NULL")
    tasks = max(1, -(-left.count() // merge_rows))
    # Longest first leaves the cuts to the shorter pieces.
    merged = left.repartition(tasks, F.xxhash64("doc_id", "start")).sortWithinPartitions(F.desc("length"), "doc_id", "start").mapInArrow(merge, schema)
    return done.where("sequence_id IS NOT NULL").unionByName(merged).drop("ids")
