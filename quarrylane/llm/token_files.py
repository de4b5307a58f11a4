"""Token ids in patched frame-of-reference blocks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, shuffle_parts, small_batches
from .tokens import encoder

BLOCK = 128
PAGE_IDS = 1 << 16
PAGE = "shard int, page int, doc_ids array<long>, n_tokens array<int>, n_ids int, base binary, width binary, starts binary, packed binary, exception_counts binary, exception_at binary, exception_bits binary"


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> dict[str, bytes]:
    """Patched frame of reference: each block of 128 ids less its minimum, packed at the width that holds ``share`` of
    its values. Wider values keep their low bits there; place in the block and high bits stand in exception lists.

    base (u4, minimum of each block), width (u1), starts (u4, byte where the block's bits begin; one more at the end),
    packed, exception_counts (u1), exception_at (u1), exception_bits (u4, the value shifted right by the width)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, np.uint32)
    v[:n] = ids
    if n:
        v[n:] = ids[-1]
    v = v.reshape(blocks, BLOCK)
    base = v.min(axis=1, initial=np.uint32(0xFFFFFFFF)) if blocks else np.zeros(0, np.uint32)
    d = v - base[:, None]
    k = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    at_share = np.partition(d, k, axis=1)[:, k] if blocks else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(at_share.astype(np.float64) + 1)).astype(np.uint8)
    starts = np.zeros(blocks + 1, np.uint32)
    np.cumsum(width.astype(np.uint32) * (BLOCK // 8), out=starts[1:])
    packed = np.zeros(int(starts[-1]), np.uint8)
    high = d >> np.minimum(width, 31)[:, None].astype(np.uint32)
    high[width == 32] = 0
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            wide = 2 if w <= 16 else 4  # bytes
            bits = np.unpackbits(d[rows].astype(f"<u{wide}").view(np.uint8).reshape(len(rows), BLOCK, wide), axis=2, bitorder="little")[:, :, :w]
            out = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            packed[starts[rows][:, None] + np.arange(out.shape[1], dtype=np.uint32)] = out
    block, at = np.nonzero(high)
    return {
        "base": base.astype("<u4").tobytes(), "width": width.tobytes(), "starts": starts.astype("<u4").tobytes(), "packed": packed.tobytes(),
        "exception_counts": np.bincount(block, minlength=blocks).astype(np.uint8).tobytes(), "exception_at": at.astype(np.uint8).tobytes(), "exception_bits": high[block, at].astype("<u4").tobytes(),
    }


def decode_blocks(n: int, page: dict, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a page, or those of its blocks ``first`` to ``last`` (exclusive), found by the index of starts."""
    base, width = np.frombuffer(page["base"], "<u4"), np.frombuffer(page["width"], np.uint8)
    starts, packed = np.frombuffer(page["starts"], "<u4"), np.frombuffer(page["packed"], np.uint8)
    counts = np.frombuffer(page["exception_counts"], np.uint8).astype(np.int64)
    at, bits = np.frombuffer(page["exception_at"], np.uint8), np.frombuffer(page["exception_bits"], "<u4")
    last = len(base) if last is None else last
    d = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[first:last]):
        rows = np.flatnonzero(width[first:last] == w)
        if w:
            part = packed[starts[first + rows][:, None] + np.arange(int(w) * (BLOCK // 8), dtype=np.uint32)]
            flags = np.unpackbits(part, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            wide = 2 if w <= 16 else 4
            full = np.zeros((len(rows), BLOCK, 8 * wide), np.uint8)
            full[:, :, :w] = flags
            d[rows] = np.packbits(full, axis=2, bitorder="little").view(f"<u{wide}").reshape(len(rows), BLOCK)
    ends = np.cumsum(counts)
    lo, hi = (int(ends[first - 1]) if first else 0), (int(ends[last - 1]) if last else 0)
    block = np.repeat(np.arange(first, last), counts[first:last])
    d[block - first, at[lo:hi]] |= bits[lo:hi] << width[block].astype(np.uint32)
    return (d + base[first:last, None]).reshape(-1)[: n - first * BLOCK]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, share: float = 0.9, shards: int | None = None) -> None:
    """Write the ids of all documents, an end id after each, in ascending doc_id order (null first).

    The table at ``path`` is a Parquet folder: a shard for each range of doc_id, a row for each page of at least
    65,536 ids of whole documents (fewer at a shard's end), with the ids in the blocks of ``encode_blocks`` and the
    page's documents and their token counts as its index. Spark writes it, so any file system will do. A null or empty
    text is the end id alone; repeated rows are written as often as they occur; no documents give no pages."""
    spark = docs.sparkSession

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode_batch, np.array([end_id], "<u4").tobytes()
        shard, page, held = TaskContext.get().partitionId(), 0, []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            row = {"shard": shard, "page": page, "doc_ids": [d for d, _ in held], "n_tokens": [len(x) // 4 for _, x in held], "n_ids": len(ids)} | encode_blocks(ids, share)
            return pa.RecordBatch.from_pylist([row], schema=_PAGE_ARROW)

        for batch in small_batches(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= PAGE_IDS:
                    yield flush()
                    page, size = page + 1, 0
                    held.clear()
        if held:
            yield flush()

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shards or shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(pages, PAGE).write.option("compression", "uncompressed").parquet(path)


_PAGE_ARROW = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("n_ids", pa.int32()), *((c, pa.binary()) for c in ("base", "width", "starts", "packed", "exception_counts", "exception_at", "exception_bits"))])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the files.

    A page holds whole documents, so pages are decoded apart; starts come from the index columns alone: a running
    sum over the pages of a shard and one over the shards."""
    table = spark.read.schema(PAGE).parquet(path)
    totals = table.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each shard
    shards = totals.select(F.col("shard").alias("_shard"), F.coalesce(before, F.lit(0)).alias("_shard_start"))
    in_shard = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    index = table.select("shard", "page", F.coalesce(in_shard, F.lit(0)).alias("_page_start"))
    index = index.join(shards, F.col("shard") == F.col("_shard")).select(F.col("shard").alias("_s"), F.col("page").alias("_p"), (F.col("_shard_start") + F.col("_page_start")).alias("_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                page = batch.slice(i, 1).to_pylist()[0]
                ids = decode_blocks(page["n_ids"], page).astype("<u4").tobytes()
                counts = np.array(page["n_tokens"], np.int64)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"_s": [page["shard"]] * len(crc), "_p": [page["page"]] * len(crc), "doc_id": pa.array(page["doc_ids"], pa.int64()), "_in": ends - counts, "n_tokens": counts, "ids_crc32": crc}, schema=_DOC_ARROW)

    docs = table.mapInArrow(decode, "_s int, _p int, doc_id long, _in long, n_tokens long, ids_crc32 long")
    return docs.join(index, ["_s", "_p"]).select("doc_id", (F.col("_start") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


_DOC_ARROW = pa.schema([("_s", pa.int32()), ("_p", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "_in", "n_tokens", "ids_crc32"))])


def token_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
