"""Whitening of embeddings: principal components by a randomised range finder, over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite_vectors, shuffle_parts, staged, usual_dimension

SCALE, OFFSET = 1024, 100_000
#: Residuals above this share of the largest eigenvalue send the search to the full dimension.
TOLERANCE = 1e-13
#: Eigenvalues below this share of the largest aren't told from rounding.
LEAST_SHARE = 1e-11


def scaled_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x: packed longs floor(1024 * c) + 100000) of the rows whose vector holds finite entries alone. An entry
    that passes 62 bits has no long and leaves its row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in finite_vectors(batch.column("vector")):
                with np.errstate(over="ignore"):
                    x = np.floor(m * SCALE)
                fits = (np.abs(x) < 2.0**62).all(axis=1)
                packed = [r.tobytes() for r in x[fits].astype("<i8") + OFFSET]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows[fits])), pa.array(packed, pa.binary())], names=["vec_id", "x"])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).mapInArrow(run, "vec_id long, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


class Whitening:
    """A fitted whitening: ``n`` rows, exact ``sums`` by dimension, ``vectors`` (a column for each component, by falling
    eigenvalue), ``values`` (eigenvalues), ``explained`` (their shares of the trace) and ``identity_error`` (largest entry
    of the whitened rows' covariance less the identity). Only these reach the driver: dimension times components numbers,
    and dimension squared where the search needs the full dimension."""

    def __init__(self, rows: DataFrame, dim: int, n: int, sums: list[int]):
        self.rows, self.dim, self.n, self.sums = rows, dim, n, sums
        self.vectors, self.values, self.explained, self.identity_error = np.zeros((dim, 0)), np.zeros(0), np.zeros(0), 0.0
        self.base = np.array([s // n for s in sums], np.int64) if n else np.zeros(dim, np.int64)
        self.rest = [s % n for s in sums] if n else []

    @classmethod
    def fit(cls, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, oversample: int = 8, power: int = 4) -> Whitening:
        """Range finder of Halko, Martinsson and Tropp (2011): a random basis of ``components`` + ``oversample`` directions
        is multiplied by the covariance, and made orthogonal, ``power`` times; then Rayleigh-Ritz in the basis gives
        eigenvectors, with their residuals. If a residual passes ``TOLERANCE``, the basis becomes the full space, where
        Rayleigh-Ritz is exact. Every product is a pass over all centred rows.

        Rows whose vector is null, empty or holds a null or non-finite entry take no part, nor do vectors of another
        dimension than most have (of equally many the larger). Rows that repeat count each, null ids too. Components
        without variance (below ``LEAST_SHARE`` of the largest) can't be scaled and aren't there; so equal rows, a single
        row or an empty table give none."""
        rows = staged(scaled_rows(table, id_col, vector_col), "whitening-rows")
        dim, n = usual_dimension(rows)
        rows = rows.where(F.length("x") == 8 * dim)
        self = cls(rows, dim, n, _sums(rows, dim))
        if n:
            self._search(components, oversample, power)
        return self

    def _search(self, components: int, oversample: int, power: int) -> None:
        squares = self._reduced(lambda c: (c * c).sum(axis=0)[:, None], 1)[:, 0]
        trace = float(squares.sum()) / self.n
        if trace == 0:
            return
        basis = np.linalg.qr(np.random.default_rng(11).normal(size=(self.dim, min(self.dim, components + oversample))))[0]
        for _ in range(power if basis.shape[1] < self.dim else 0):
            basis = np.linalg.qr(self._times(basis))[0]
        values, vectors, residual = self._ritz(basis)
        if residual[:components].max() > TOLERANCE * values[0] and basis.shape[1] < self.dim:
            values, vectors, _ = self._ritz(np.eye(self.dim))
        kept = min(components, int((values > LEAST_SHARE * values[0]).sum()))
        self.values, self.vectors = values[:kept], vectors[:, :kept]
        self.explained = self.values / trace
        scaled = self.vectors / np.sqrt(self.values)
        mean = self._reduced(lambda c: (c @ scaled).sum(axis=0)[None, :], kept)[0] / self.n

        def products(c: np.ndarray) -> np.ndarray:
            w = c @ scaled - mean
            return w.T @ w

        self.identity_error = float(np.abs(self._reduced(products, kept) / self.n - np.eye(kept)).max())

    def _times(self, basis: np.ndarray) -> np.ndarray:
        """Covariance times ``basis``."""
        return self._reduced(lambda c: c.T @ (c @ basis), basis.shape[1]) / self.n

    def _ritz(self, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        image = self._times(basis)
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = basis @ turn
        return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)

    def _centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x less the mean, rounded once: the whole part of the mean goes in whole numbers."""
        base, part = self.base, np.array([r / self.n for r in self.rest])
        return lambda x: (x - base) - part

    def _reduced(self, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """The sum of ``part`` (matrices ``width`` wide) over all centred rows: added up in each task, then by matrix row on Spark."""
        schema, centred = "i int, v array<double>", self._centred()

        def table(at: list[int], m: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(m.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), lists], names=["i", "v"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    more = part(centred(_matrix(batch.column("x").slice(a, 4096))))
                    total = more if total is None else total + more
            if total is not None:
                yield table(list(range(len(total))), np.ascontiguousarray(total, np.float64))

        def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                m = batch.column("v").flatten().to_numpy().reshape(-1, width)
                for i, row in zip(batch.column("i").to_pylist(), m, strict=True):
                    totals[i] = totals[i] + row if i in totals else row.copy()
            if totals:
                yield table(list(totals), np.stack(list(totals.values())))

        parts = self.rows.select("x").mapInArrow(add, schema)
        out = parts.repartition(shuffle_parts(self.rows.sparkSession), "i").mapInArrow(by_row, schema).collect()
        return np.array([r["v"] for r in sorted(out, key=lambda r: r["i"])]).reshape(len(out), width)

    def transform(self, rows: DataFrame | None = None) -> DataFrame:
        """vec_id, deviation (exact sum over dimensions of (n * x - S)**2; null where it passes 38 digits) and whitened (an
        array of doubles, by component) of the fitted rows, or of others from ``scaled_rows``."""
        n, rest, base, dim, centred, scaled = self.n, self.rest, self.base, self.dim, self._centred(), self.vectors / np.sqrt(self.values)
        small = np.array(rest, np.float64)

        def deviation(x: np.ndarray) -> list[str | None]:
            a = x - base
            # n * x - S = n * a - rest, so its square sums to n**2 sum(a**2) - 2 n sum(a * rest) + sum(rest**2).
            if (np.abs(a).max(initial=0) + 1.0) ** 2 * dim < 2.0**62 and (np.abs(a) @ small).max(initial=0) < 2.0**61:
                one, two = (a * a).sum(axis=1).tolist(), (a * np.array(rest, np.int64)).sum(axis=1).tolist()
            else:
                one = [sum(v * v for v in r) for r in a.tolist()]
                two = [sum(v * s for v, s in zip(r, rest, strict=True)) for r in a.tolist()]
            three = sum(s * s for s in rest)
            totals = [n * n * p - 2 * n * q + three for p, q in zip(one, two, strict=True)]
            return [str(t) if t < 10**38 else None for t in totals]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = _matrix(part.column("x"))
                    w = centred(x) @ scaled
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviation(x), pa.string()), lists], names=["vec_id", "deviation", "whitened"])

        rows = self.rows if rows is None else rows.where(F.length("x") == 8 * self.dim)
        out = rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation string, whitened array<double>")
        return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def _sums(rows: DataFrame, dim: int) -> list[int]:
    """Exact sums by dimension: high and low halves are added apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                high += (x >> 31).sum(axis=0)
                low += (x & ((1 << 31) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    if not dim:
        return []
    parts = rows.select("x").mapInArrow(add, "i int, high long, low long")
    sums = parts.groupBy("i").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return [(int(r["high"]) << 31) + int(r["low"]) for r in sorted(sums.collect(), key=lambda r: r["i"])]
