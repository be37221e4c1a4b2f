"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader.

Features are hashed unigrams and bigrams of tokens (a token is a run of word characters or a run of
other non-space characters, case kept); two equal neighbours hash to one shared bigram, so that
repetition is a feature of its own. Counts are scaled to unit length, and a score is the logistic
function of the sparse dot product with the learned weights. The model is fitted on a bounded sample
of labelled rows (``TRAIN_ROWS``), chosen by hashed id; every text is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskpark.llm.common import learnable, sample_rows

#: Labelled rows to learn from at most: the bound of the sample that meets on the driver.
TRAIN_ROWS = 3000
#: Tokens of one text that are counted at a time.
_SLICE = 1 << 18
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REPEAT = 0x52455045


class _Hashes(dict):
    """Token -> 32-bit hash; emptied when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[token] = value = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


def features(text: str | None, bits: int, hashes: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers below 2**bits and their values, scaled to unit length; none for a text without token."""
    hashes = _Hashes() if hashes is None else hashes
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    parts, last = [], None
    for at in range(0, len(tokens), _SLICE):
        one = np.array([hashes[t] for t in tokens[at: at + _SLICE]], np.uint64)
        before = one[:-1] if last is None else np.concatenate((last, one[:-1]))
        after = one[1:] if last is None else one
        two = before * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F)
        two[before == after] = _REPEAT
        both = np.concatenate((one, two)) * np.uint64(0xD6E8FEB86659FD93)
        parts.append(np.unique(both >> np.uint64(64 - bits), return_counts=True))
        last = one[-1:]
    at, count = parts[0] if len(parts) == 1 else _merged(parts)
    value = count / np.sqrt((count.astype(float) ** 2).sum())
    return at.astype(np.int64), value


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return at, np.bincount(where, np.concatenate([p[1] for p in parts]))


@dataclass
class Model:
    bits: int
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, hashes: dict | None = None) -> float:
        at, value = features(text, self.bits, hashes)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at] @ value, -30, 30))))


def fit(rows: list[tuple[str | None, int]], bits: int = 20, alpha: float = 0.3, beta: float = 1.0,
        l1: float = 0.02, l2: float = 0.5, epochs: int = 3) -> Model:
    """Per-coordinate FTRL-proximal over the rows in their order; without rows every score is one half."""
    hashes = _Hashes()
    seen = [(*features(text, bits, hashes), int(y)) for text, y in rows]
    return fit_features(seen, bits, alpha, beta, l1, l2, epochs)


def fit_features(seen: list[tuple[np.ndarray, np.ndarray, int]], bits: int, alpha: float = 0.3, beta: float = 1.0,
                 l1: float = 0.02, l2: float = 0.5, epochs: int = 3) -> Model:
    size = 1 << bits  # the bias is one more coordinate, without a penalty
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        free = at == size
        shrunk = np.where(free, z[at], np.sign(z[at]) * np.maximum(0, np.abs(z[at]) - l1))
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + np.where(free, 1e-6, l2))

    for _ in range(epochs):
        for at, value, y in seen:
            at, value = np.append(at, size).astype(np.int64), np.append(value, 1.0).astype(float)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - y) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return Model(bits, w[:size].astype(np.float32), float(w[size]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, bits: int = 20) -> Model:
    """Learns ``label`` (0 or 1) from rows of ``labels`` (doc_id, ...) that may be learned from.

    A document with several labels counts by their mean (one half is 1); null labels and ids are
    ignored; an id without a document is ignored; of repeated documents each row counts. At most
    ``rows`` labelled ids are used; their features, not their texts, come to the driver.
    """
    marked = labels.where(learnable(F.col("doc_id")) & F.col(label).isNotNull())
    marked = marked.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    marked = sample_rows(marked, rows, "y")

    @F.pandas_udf("at array<int>, value array<float>")
    def extract(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in texts:
            found = [features(t, bits, hashes) for t in batch]
            yield pd.DataFrame({"at": [f[0].astype(np.int32) for f in found], "value": [f[1].astype(np.float32) for f in found]})

    known = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    known = known.select("doc_id", "y", F.xxhash64("text").alias("named"), extract("text").alias("f"))
    # An id may be repeated: its texts are put in order by their hash, and at most as many rows are taken in all.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "named").limit(rows).select("doc_id", "y", "named", "f.at", "f.value")
    got = known.toPandas()
    got["order"] = [zlib.crc32(str(i).encode()) for i in got.doc_id]
    got = got.sort_values(["order", "doc_id", "named"], kind="stable")
    return fit_features(list(zip(got["at"], got["value"], got["y"])), bits)


def score_column(text: Column, model: Model) -> Column:
    """Score of each whole text, from 0 to 1; a null or empty text gets the score of the bias alone."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)  # 2**bits floats, whatever the input

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, m = _Hashes(), shared.value
        for batch in texts:
            yield pd.Series([m.score(t, hashes) for t in batch], dtype=float)

    return score(text)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, score, predicted): one row for each input row, other columns are not read."""
    out = docs.select("doc_id", score_column(F.col("text"), model).alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with all their columns whose score is at least ``threshold``."""
    return docs.where(score_column(F.col("text"), model) >= threshold)
