"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed words, hashed byte n-grams of the text, and hashed n-grams of word shapes (a run of
letters of one case or of digits counts as one sign) with repetitions of words. Each of the three groups
has unit length and a fixed share. Term weights of the labelled sample are factored by a truncated singular
value decomposition; the sample's vectors are broadcast and compared with every document in
blocks of exact cosine products, and the nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.samples import even_sample

SHAPES = 1024
WORDS = 1 << 15
GRAMS = 1 << 15
TERMS = SHAPES + WORDS + GRAMS
GROUPS = [(0, SHAPES, 0.6), (SHAPES, SHAPES + WORDS, 0.2), (SHAPES + WORDS, TERMS, 0.2)]  # first, last, share of a cosine
GRAM = 4  # bytes of an n-gram
_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
NEIGHBOURS = 100
FIT_TERMS = 1 << 10  # terms looked at together in fitting
FIT_ROWS = 1 << 8  # rows whose products are made at once
STRETCH = 1 << 16  # bytes of a text whose shapes are counted at once
_REPEATED, _CHANGED, _FIRST_HASHED = 0, 1, 2
_LOWER, _UPPER, _DIGIT, _OTHER = 1, 2, 3, 4
SIGNS = 64


def _signs() -> np.ndarray:
    """A sign below SIGNS for each byte; letters beyond ASCII count as lower case."""
    table = np.full(256, _OTHER, np.int64)
    table[128:] = _LOWER
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("0") : ord("9") + 1] = _DIGIT
    marks = [b for b in range(32, 127) if not chr(b).isalnum()] + [ord("\n"), ord("\t")]
    table[marks] = np.arange(len(marks)) + 5
    return table


_SIGN = _signs()


def _shape_counts(octets: np.ndarray) -> np.ndarray:
    """Counts of the hashed shapes of a whole text, in stretches that overlap by what an n-gram can span."""
    counts = np.zeros(SHAPES)
    last = np.zeros(2, np.int64)  # the signs before the stretch
    previous = -1
    for first in range(0, len(octets) + 1, STRETCH):
        sign = _SIGN[octets[first : first + STRETCH]]
        before = np.append(previous, sign[:-1]) if len(sign) else sign
        fresh = (sign != before) | (sign > _DIGIT)
        previous = int(sign[-1]) if len(sign) else previous
        own = sign[fresh]
        if first + STRETCH > len(octets):
            own = np.append(own, 0)  # the end of the text
        run = np.concatenate((last, own))
        for width in (2, 3):
            ends = run[2 - width + 1 :]  # n-grams that end in this stretch
            code = ends[: len(ends) - width + 1].copy()
            for k in range(1, width):
                code = code * SIGNS + ends[k : len(ends) - width + 1 + k]
            slot = ((code * 0x9E3779B1 + width) % 4294967291) % (SHAPES - _FIRST_HASHED) + _FIRST_HASHED
            counts += np.bincount(slot, minlength=SHAPES)
        last = run[-2:]
    return counts


def _word_slots(octets: np.ndarray) -> np.ndarray:
    """Slots of the words in a stretch that begins and ends with a space: sums of bytes times powers of a factor."""
    inside = octets != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(starts):
        return np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(octets)))
    place = np.arange(starts[0], len(octets)) - np.repeat(starts, length)
    powers = np.multiply.accumulate(np.full(int(length.max()), _FACTOR, np.uint64))
    value = octets[starts[0] :].astype(np.uint64) * inside[starts[0] :]
    return _slot(np.add.reduceat(value * powers[place], starts - starts[0]), WORDS) + SHAPES


def _gram_slots(octets: np.ndarray) -> np.ndarray:
    """Slots of the n-grams of a stretch."""
    value = octets.astype(np.uint64)
    code = value[: len(value) - GRAM + 1]
    for k in range(1, GRAM):
        code = (code << np.uint64(8)) | value[k : len(value) - GRAM + 1 + k]
    return _slot(code, GRAMS) + SHAPES + WORDS


def _slot(code: np.ndarray, slots: int) -> np.ndarray:
    """The high bits of a product; slots is a power of two."""
    code = (code ^ (code >> np.uint64(29))) * _SPREAD
    return (code >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _word_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms and counts of the hashed words and byte n-grams of a whole text with single spaces, in stretches cut at spaces."""
    octets = f" {' '.join(text.lower().split())} ".encode()
    terms, counts, first = np.zeros(0, np.int64), np.zeros(0), 0
    while first < len(octets) - 1:
        last = octets.find(b" ", first + STRETCH)
        last = len(octets) - 1 if last < 0 else last
        # n-grams that begin before the last space belong to this stretch
        part = np.frombuffer(octets, np.uint8, min(last + GRAM - 1, len(octets)) - first, first)
        found, times = np.unique(np.concatenate([_word_slots(part[: last + 1 - first]), _gram_slots(part)]), return_counts=True)
        if first:
            both = np.union1d(terms, found)
            merged = np.zeros(len(both))
            merged[np.searchsorted(both, terms)] += counts
            merged[np.searchsorted(both, found)] += times
            terms, counts = both, merged
        else:
            terms, counts = found, times.astype(float)
        first = last
    return terms, counts


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms of one whole text, ascending, and their counts."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0)
    shapes = _shape_counts(np.frombuffer(text.encode(), np.uint8))
    words = text.split()
    shapes[_REPEATED] = sum(map(eq, words, words[1:]))
    shapes[_CHANGED] = max(0, len(words) - 1) - shapes[_REPEATED]
    used = np.flatnonzero(shapes)
    terms, counts = _word_terms(text)
    return np.concatenate([used, terms]), np.concatenate([shapes[used], counts])


def _values(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Square roots of the shares of the terms in their group, weighted, each group at its share of unit length."""
    out = np.zeros(len(terms), np.float32)
    bounds = np.searchsorted(terms, [b for b, _, _ in GROUPS] + [TERMS])
    for (_, _, share), a, b in zip(GROUPS, bounds, bounds[1:], strict=False):
        values = np.sqrt(counts[a:b] / max(counts[a:b].sum(), 1.0))
        values = values if weights is None else values * weights[terms[a:b]]
        length = np.linalg.norm(values)
        out[a:b] = values / length * np.sqrt(share) if length > 1e-12 else 0.0
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 1e-12)


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequency of each term
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, unit length
    labels: np.ndarray  # 0 or 1
    sharpness: float

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return _unit(np.array([_values(t, n, self.weights) @ self.axes[t] for t, n in rows]).reshape(len(rows), -1))

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, each weighted by exp(sharpness * (cosine - 1)).

        Rows as near as the last of the nearest vote too, so no order decides.
        """
        cosines = np.round(self.project(rows).astype(float) @ self.vectors.T.astype(float), 9)
        k = min(NEIGHBOURS, cosines.shape[1])
        least = np.partition(cosines, -k, axis=1)[:, -k]
        votes = np.exp(self.sharpness * (cosines - cosines.max(axis=1, keepdims=True))) * (cosines >= least[:, None])
        return np.clip(votes @ self.labels / votes.sum(axis=1), 0.0, 1.0)


def _columns(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """The matrix of rows (terms, values) in runs of FIT_TERMS columns, each with the first of its columns."""
    for first in range(0, TERMS, FIT_TERMS):
        part = np.zeros((len(rows), FIT_TERMS), np.float32)
        for at, (terms, values) in enumerate(rows):
            a, b = np.searchsorted(terms, (first, first + FIT_TERMS))
            part[at, terms[a:b] - first] = values[a:b]
        yield first, part


def _largest(products: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors of a symmetric matrix, by subspace iteration from a fixed start."""
    q = np.random.default_rng(5).normal(size=(len(products), min(len(products), k + 16))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(products @ q)[0]
    values, inner = np.linalg.eigh((q.T @ (products @ q)).astype(np.float64))
    order = np.argsort(-values)[:k]
    return values[order], q @ inner[:, order].astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = 64, sharpness: float = 30.0) -> Model:
    """Model from term counts of some texts and their labels 0/1; needs one row.

    The sample's rows are fewer than the terms, so the decomposition is that of their products with each other,
    summed over runs of terms. Beside the rows, memory holds one square array of them or the axes, never both.
    """
    found = np.bincount(np.concatenate([t for t, _ in rows]).astype(np.int64), minlength=TERMS)
    weights = np.log((1 + len(rows)) / (1 + found)) + 0.1
    weighed = [(t, _values(t, n, weights)) for t, n in rows]
    products = np.zeros((len(rows), len(rows)), np.float32)
    for _, part in _columns(weighed):
        for at in range(0, len(rows), FIT_ROWS):  # the sum is the only square array
            products[at : at + FIT_ROWS] += part[at : at + FIT_ROWS] @ part.T
    values, left = _largest(products, dimensions)
    del products
    best = np.flatnonzero(values > 1e-5)
    axes = np.zeros((TERMS, max(1, len(best))), np.float32)
    sides = (left[:, best] / np.sqrt(values[best])).astype(np.float32)
    for first, part in _columns(weighed) if len(best) else ():
        axes[first : first + FIT_TERMS] = (part.T @ sides)[: TERMS - first]
    model = Model(weights, axes, np.zeros((0, 1)), labels.astype(float), sharpness)
    model.vectors = model.project(rows)
    return model


def _packed(text: str | None) -> bytes:
    terms, counts = term_counts(text)
    return zlib.compress(np.diff(terms, prepend=0).astype("<u4").tobytes() + counts.astype("<f4").tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = len(raw) // 8
    return np.cumsum(np.frombuffer(raw, "<i4", n), dtype=np.int32), np.frombuffer(raw[4 * n :], "<f4", n)


def _counts_column(text: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def counts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_packed(t) for t in texts], dtype=object)

    return counts_of(text)


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500, total: int = 3000) -> Model | None:
    """Fits on at most total labelled documents; None where no document has a label.

    docs: doc_id, text; labels: doc_id, label (0 or 1, others are ignored). An id labelled
    both ways counts as the smaller label; where ids repeat in docs, the rows with the least hashes stay, so reruns
    agree. Only term counts of the sample (8 bytes a different term, of TERMS, compressed on the way) reach the driver, never texts.
    """
    clean = labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = even_sample(clean, per_label, total)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    hashed = F.xxhash64("doc_id", "text").alias("h")
    rows = sample.select("doc_id", "label", hashed, _counts_column(F.col("text")).alias("counts")).orderBy("h", "doc_id").limit(total)
    rows = rows.toPandas()
    return fit([_unpacked(c) for c in rows["counts"]], rows["label"].to_numpy("int64")) if len(rows) else None


def quality_score(text: Column, model: Model | None, spark, block_rows: int = 512) -> Column:
    """Score between 0 and 1 for each whole text, higher where label 1 is likelier.

    Null and empty texts have a vector of zero length, which is equally far from all labelled
    rows; their score is the share of label 1. Without a model all scores are 0.5.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = held.value
        for texts in batches:
            if known is None:
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            parts = [
                known.score([term_counts(t) for t in texts.iloc[i : i + block_rows]])
                for i in range(0, len(texts), block_rows)
            ]
            yield pd.Series(np.round(np.concatenate([*parts, np.zeros(0)]), 9))

    return scores(text)
