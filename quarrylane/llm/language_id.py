"""Language identification by error-correcting output codes over hashed letter n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_buffers

BITS = 12
CELLS = 1 << BITS
_ASCII_LETTER = re.compile("[A-Za-z]")
# Bytes of n-grams: A-Z lower-cased, bytes beyond ASCII as they are, all else one blank.
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def features(column: pa.Array) -> np.ndarray:
    """Root frequencies of hashed bigrams and trigrams, a row of 4096 cells for each whole text, of length 1 (or 0)."""
    data, off = text_buffers(column)
    n = len(off) - 1
    out = np.zeros(n * CELLS, np.int64)
    codes = _CLASS[data]
    doc = np.repeat(np.arange(n, dtype=np.int64) * CELLS, np.diff(off))
    for size, factors in ((2, (155, 1)), (3, (24025, 155, 1))):
        if len(codes) < size:
            continue
        m = len(codes) - size + 1
        gram = np.zeros(m, np.uint32)
        for k, f in enumerate(factors):
            gram += codes[k : k + m] * np.uint32(f)
        cell = ((gram + np.uint32(size << 24)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        same = (doc[:m] == doc[size - 1 :]) & (gram > 0)
        out += np.bincount(doc[:m][same] + cell[same], minlength=n * CELLS)
    out = np.sqrt(out.reshape(n, CELLS).astype(np.float32))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """An n-row matrix of -1 and 1: all distinct splits up to 6 languages, else the best of 50 random codes of
    10 * log2(n) bits by least distance between rows."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        splits = [[1] + [1 if (x >> i) & 1 else -1 for i in range(n - 1)] for x in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.float32).T.copy()
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, int(np.ceil(10 * np.log2(n)))))
        far = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9
        if far.min() > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, far.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # cells x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit's classifier, from its error on rows kept out of its fit
    scale: float = 1.0

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by trusted logistic loss: language index, score, margin to the runner-up (both 0 to 1)."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * row) * self.trust).sum(axis=1) for row in self.code], axis=1)
        p = np.exp(-self.scale * (loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        top = p.argmax(axis=1)
        ordered = np.sort(p, axis=1)
        second = ordered[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return top, ordered[:, -1], ordered[:, -1] - second


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 200, ridge: float = 1e-4) -> LanguageModel:
    """One logistic classifier for each bit, by full-batch Nesterov steps; every fifth row only measures a bit's error."""
    code = codewords(len(languages))
    z = code[y]
    test = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    share = np.bincount(y[~test], minlength=len(languages)).astype(np.float32)
    row = (1.0 / np.maximum(share, 1))[y[~test]][:, None]
    row /= row.sum()
    a, b = x[~test], z[~test]
    w, bias, vw, vb = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), 0.0, 0.0
    for _ in range(rounds):
        g = -b * row / (1 + np.exp(np.clip(b * (a @ (w + 0.9 * vw) + bias + 0.9 * vb), -30, 30)))
        vw, vb = 0.9 * vw - 4.0 * (a.T @ g + ridge * w), 0.9 * vb - 4.0 * g.sum(axis=0)
        w, bias = (w + vw).astype(np.float32), (bias + vb).astype(np.float32)
    checked = test if test.any() else ~test
    error = (np.sign(x[checked] @ w + bias) != z[checked]).mean(axis=0) if checked.any() else np.zeros(code.shape[1])
    trust = np.maximum(0.05, 1 - 2 * error)
    return LanguageModel(languages, code, w, bias, (trust / trust.sum()).astype(np.float32), float(2 * code.shape[1]))


def train(docs: DataFrame, sample_rows: int = 4000, min_rows: int = 16) -> LanguageModel | None:
    """Fit on about ``sample_rows`` labelled rows (text and lang not null), the same share for every language and
    ``min_rows`` at least, picked by a hash of doc_id. The bound is the model's only; None without labelled rows.

    The sample meets in one task, whose memory the bound holds to about ``sample_rows`` times 64 kB. Only counts by
    language and the fitted model (4096 floats a bit) reach the driver."""
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    languages = sorted(counts)
    quota = max(min_rows, sample_rows // len(languages))
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    shares = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, quota / counts[k])))])
    picked = labelled.where(draw <= F.element_at(shares, F.col("lang"))).select("doc_id", "lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = features(batch.column("text")).astype("<f2")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(languages)}
        x, y = [], []
        for batch in batches:
            x.append(np.frombuffer(b"".join(batch.column("x").to_pylist()), "<f2").reshape(-1, CELLS).astype(np.float32))
            y += [place[k] for k in batch.column("lang").to_pylist()]
        if y:
            m = fit(np.concatenate(x), np.array(y), languages)
            parts = [a.astype("<f4").tobytes() for a in (m.code, m.weights, m.bias, m.trust)]
            yield pa.RecordBatch.from_pydict({"code": [parts[0]], "weights": [parts[1]], "bias": [parts[2]], "trust": [parts[3]], "scale": [m.scale]})

    sample = picked.mapInArrow(vectors, "doc_id long, lang string, x binary").repartition(1).sortWithinPartitions("doc_id", "lang", "x")
    row = sample.mapInArrow(fitted, "code binary, weights binary, bias binary, trust binary, scale double").first()
    if row is None:
        return None
    code, weights, bias, trust = (np.frombuffer(row[c], "<f4") for c in ("code", "weights", "bias", "trust"))
    return LanguageModel(languages, code.reshape(len(languages), -1), weights.reshape(CELLS, -1), bias, trust, row["scale"])


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def with_letter(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array([has_letter(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: LanguageModel | None, ambiguous_below: float = 0.2) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous (the runner-up is within ``ambiguous_below``).

    Whole texts are read and no other column. A text that is null or has no letter is ``und`` with score 0, and so is
    every text without a model. Repeated rows get equal results; columns named like the results are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model  # 4096 floats a bit, sent with the function
        for batch in small_batches(batches):
            sure = np.array([has_letter(t) for t in batch.column("text").to_pylist()], bool)
            if m is None:
                sure[:] = False
                top, score, margin = (np.zeros(batch.num_rows, int) for _ in range(3))
            else:
                top, score, margin = m.decode(features(batch.column("text")))
            names = [m.languages[t] if s else "und" for t, s in zip(top, sure, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.where(sure, score, 0.0).astype(np.float64)), pa.array(sure & (margin < ambiguous_below))], names=[*keep, "lang_pred", "score", "ambiguous"])

    schema = type(docs.schema)([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
