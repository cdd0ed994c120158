"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are byte n-grams of the lower-cased text with one space at each end. A text is the
mean of its subwords' embeddings; embeddings and softmax are trained together by stochastic
gradient descent in numpy. A temperature and a rejection threshold are fitted on rows that
training did not see.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.samples import even_sample

BUCKETS = 1 << 13
WIDTHS = (1, 2, 3, 4)
UNKNOWN = "und"
RESULT = "lang_pred string, score double, rejected boolean"


STRETCH = 1 << 16  # bytes of a text whose subwords are counted at once


def _slots(octets: np.ndarray, width: int) -> np.ndarray:
    """The bucket of every subword of one width."""
    code = octets[: len(octets) - width + 1]
    for k in range(1, width):
        code = code * np.uint32(257) + octets[k : len(octets) - width + 1 + k]
    mixed = (code ^ np.uint32(width * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def subword_counts(text: str) -> np.ndarray:
    """How many subwords of a whole text fall into each bucket; a long text is counted in stretches."""
    octets = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for first in range(0, len(octets), STRETCH):
        part = octets[first : first + STRETCH + WIDTHS[-1] - 1].astype(np.uint32)
        for width in WIDTHS:
            own = part[: STRETCH + width - 1]  # subwords that begin in this stretch
            if len(own) >= width:
                counts += np.bincount(_slots(own, width), minlength=BUCKETS)
    return counts


def shares(text: str) -> np.ndarray:
    counts = subword_counts(text).astype(np.float32)
    return counts / counts.sum()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x languages: embeddings times softmax weights
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        """The mean over subwords is linear, so logits are means of table rows."""
        return _softmax((shares(text) @ self.table)[None, :] / self.temperature)[0]


def lessons(text: str) -> list[np.ndarray]:
    """Subword shares of a whole text and of three short passages of it, so that short texts are learnt too."""
    words = text.split()
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    starts = rng.integers(0, max(1, len(words) - 4), 3).tolist() if len(words) > 12 else []
    return [shares(piece) for piece in [text, *(" ".join(words[s : s + n]) for s, n in zip(starts, (4, 8, 12), strict=False))]]


def packed(row: np.ndarray) -> bytes:
    """The buckets in use and their shares."""
    used = np.flatnonzero(row)
    return used.astype("<u2").tobytes() + row[used].astype("<f4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    row = np.zeros(BUCKETS, np.float32)
    row[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return row


def fit(taught: list[list[np.ndarray]], labels: list[str], width: int = 16, rounds: int = 12, seed: int = 7) -> Model:
    """Trains on the lessons of each text and its label.

    A tenth of the texts calibrate: the temperature with the best likelihood on them, and the
    threshold that rejects one in a hundred of their right answers.
    """
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    held = np.arange(len(taught)) % 10 == 9 if len(taught) >= 50 else np.zeros(len(taught), bool)
    rows, targets, calibrating = [], [], []
    for pieces, label, out in zip(taught, labels, held, strict=True):
        for piece in pieces:
            rows.append(piece)
            targets.append(names.index(label))
            calibrating.append(out)
    x, y, out = np.stack(rows), np.array(targets), np.array(calibrating)
    embed = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    weight = rng.normal(0, 0.1, (width, len(names))).astype(np.float32)
    seen = np.flatnonzero(~out)
    for r in range(rounds):
        rate = 40.0 * (1 - r / rounds)
        for batch in np.array_split(rng.permutation(seen), max(1, len(seen) // 32)):
            mean = x[batch] @ embed
            gradient = _softmax(mean @ weight)
            gradient[np.arange(len(batch)), y[batch]] -= 1
            gradient /= len(batch)
            back = gradient @ weight.T
            weight -= 0.05 * rate * (mean.T @ gradient)
            embed -= rate * (x[batch].T @ back)
    table = (embed @ weight).astype(np.float64)
    fitted = Model(names, table, 1.0, 0.0)
    judge = np.flatnonzero(out) if out.any() else seen
    logits = x[judge] @ table
    losses = {}
    for temperature in (0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 4.0):
        p = _softmax(logits / temperature)
        losses[temperature] = -np.log(np.maximum(p[np.arange(len(judge)), y[judge]], 1e-12)).mean()
    fitted.temperature = min(losses, key=losses.get)
    p = _softmax(logits / fitted.temperature)
    right = p.argmax(axis=1) == y[judge]
    fitted.threshold = float(np.quantile(p.max(axis=1)[right], 0.01)) if right.any() else 0.0
    return fitted


def train(docs: DataFrame, per_language: int = 300, total: int = 3000) -> Model | None:
    """Fits on at most total rows of docs (doc_id, text, lang); None where no row can be learnt from.

    Rows without text, letter or lang are not learnt from. Of each language per_language ids are chosen by hash, of all
    of them total, so at most total languages can be learnt; where ids repeat, the rows with the least
    hashes stay, so reruns agree. Whole texts are learnt from: their subwords are counted where they lie, and at
    most 48 kB a text or passage reach the driver.
    """
    labelled = docs.select("doc_id", F.col("lang").alias("label"))
    chosen = even_sample(labelled, per_language, total)

    @F.pandas_udf("array<binary>")
    def taught(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[packed(x) for x in lessons(t)] if has_letter(t) else None for t in texts], dtype=object)

    order = ["h", "doc_id", "lang"]
    sample = (
        docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
        .filter(F.col("lang").isNotNull())
        .select("doc_id", "lang", F.xxhash64("doc_id", "lang", "text").alias("h"), taught("text").alias("lessons"))
        .orderBy(*order)
        .limit(total)
        .toPandas()
    )
    # sorted out here: as a filter, lessons would be pushed below the join and taken from all rows
    sample = sample[sample["lessons"].notna()]
    rows = [[unpacked(x) for x in pieces] for pieces in sample["lessons"]]
    return fit(rows, sample["lang"].tolist()) if rows else None


def language(text: Column, model: Model | None, spark) -> Column:
    """Struct of RESULT for each whole text.

    score is the calibrated probability of lang_pred; rejected marks scores below the
    threshold. A null text, one without any letter, and every text where there is no model
    give `und`, score 0 and rejected.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T._parse_datatype_string(RESULT))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = held.value
        for texts in batches:
            names, scores = [], []
            for text in texts:
                if known is None or not has_letter(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = known.probabilities(text)
                best = int(p.argmax())
                names.append(known.labels[best])
                scores.append(round(float(p[best]), 9))
            low = 1.0 if known is None else known.threshold
            rejected = [n == UNKNOWN or s < low for n, s in zip(names, scores, strict=True)]
            yield pd.DataFrame({"lang_pred": names, "score": scores, "rejected": rejected})

    return predict(text)
