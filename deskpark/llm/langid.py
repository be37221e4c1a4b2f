"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes, held as counts of its 4-grams. The
probability of a byte comes from its longest context that has seen it; each shorter context is reached
by an escape, whose probability is that of method C (distinct followers over followers and distinct
followers), and behind the empty context all symbols are alike. With the statistics frozen, the code
length of a byte depends on the four bytes that end in it, so the trees are unrolled into a table of
code lengths for each language, and a text's exact code length is a sum of look-ups.

Bytes are folded to ``SYMBOLS`` symbols: A-Z to a-z, digits to one, and all but the commonest bytes of
the sample to one. The language of the shortest code wins; the score is its posterior probability under equal
priors, with code lengths taken for at most ``EVIDENCE`` bytes so that long texts stay comparable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskpark.llm.common import learnable

#: Documents of a language to learn from at most.
TRAIN_ROWS = 1500
SYMBOLS, ORDER, EVIDENCE = 48, 3, 64
UNKNOWN = "und"
_PIECE = 1 << 21


def _folded() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[48:58] = 48
    return table


@dataclass
class Model:
    """Languages in order, the symbol of each byte, and (language, 4-gram, count) in three arrays."""

    languages: list[str]
    symbol: np.ndarray
    owner: np.ndarray
    gram: np.ndarray
    count: np.ndarray
    key: int = 0

    def table(self) -> np.ndarray:
        """Code length in bits of each 4-gram's last symbol under each language, (languages, SYMBOLS**4)."""
        return np.stack([code_lengths(self.gram[self.owner == k], self.count[self.owner == k]) for k in range(len(self.languages))])


def code_lengths(gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Unrolls one language's context tree, from the shortest contexts to the longest."""
    bits = np.full(SYMBOLS, np.log2(SYMBOLS), np.float32)
    for order in range(ORDER + 1):
        size = SYMBOLS ** (order + 1)
        seen = np.bincount(gram % size, count, size).reshape(-1, SYMBOLS).astype(np.float32)
        total, distinct = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True, dtype=np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = -np.log2(seen / (total + distinct))
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
        shorter = bits.reshape(-1, SYMBOLS)
        shorter = np.tile(shorter, (len(seen) // len(shorter), 1))
        bits = np.where(seen > 0, own, escape + shorter).astype(np.float32).ravel()
    return bits


def grams(data: bytes, symbol: np.ndarray) -> np.ndarray:
    """The 4-gram that ends in each byte; a text begins after three line ends."""
    s = symbol[np.frombuffer(b"\n" * ORDER + data, np.uint8)].astype(np.int32)
    return ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from (doc_id, text, lang) rows that may be learned from, at most ``rows`` ids a language; None without any.

    Rows with a null id, text or language are not learned from; of repeated ids each row counts.
    """
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang").distinct()
    # First within slices of a language, so that no task sorts all ids of a common one.
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))).orderBy(F.xxhash64("doc_id"), "doc_id")
    known = known.withColumn("r", F.row_number().over(sliced)).where(F.col("r") <= rows)
    chosen = known.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= rows).select("doc_id", "lang")
    texts = docs.select("doc_id", "lang", "text").where("text is not null")
    texts = texts.join(F.broadcast(chosen), ["doc_id", "lang"])  # at most ``rows`` ids a language

    def byte_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                n = np.zeros(256, np.int64)
                for t in own.text:
                    n += np.bincount(_folded()[np.frombuffer(_bytes(t), np.uint8)], minlength=256)
                yield pd.DataFrame({"lang": lang, "byte": np.flatnonzero(n), "n": n[n > 0]})

    bytes_ = texts.select("lang", "text").mapInPandas(byte_counts, "lang string, byte int, n long")
    found = bytes_.groupBy("lang", "byte").agg(F.sum("n").alias("n")).toPandas()  # at most 256 rows a language
    if not len(found):
        return None
    # Each language's own commonest bytes come first, so that a rare language keeps its letters.
    found["share"] = found.n / found.groupby("lang").n.transform("sum")
    best = found.groupby("byte").share.max().reset_index().sort_values(["share", "byte"], ascending=[False, True])
    common = best.byte.to_numpy()[: SYMBOLS - 1]
    of_folded = np.full(256, SYMBOLS - 1, np.uint8)
    of_folded[common] = np.arange(len(common), dtype=np.uint8)
    symbol = of_folded[_folded()]

    def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                g, n = np.unique(np.concatenate([grams(_bytes(t), symbol) for t in own.text]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": g, "n": n})

    counted = texts.select("lang", "text").mapInPandas(gram_counts, "lang string, gram int, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most SYMBOLS**4 rows a language
    counted = counted.sort_values(["lang", "gram"])
    languages = sorted(counted.lang.unique())
    owner = counted.lang.map({x: k for k, x in enumerate(languages)}).to_numpy(np.int32)
    gram, count = counted.gram.to_numpy(np.int32), counted.n.to_numpy(np.int32)
    return Model(languages, symbol, owner, gram, count, zlib.crc32(gram.tobytes() + count.tobytes()))


_TABLES: dict[int, np.ndarray] = {}


def bits(model: Model, texts: list[str]) -> np.ndarray:
    """Exact code length of each whole, non-empty text under each language, (texts, languages)."""
    if model.key not in _TABLES:
        _TABLES.clear()
        _TABLES[model.key] = model.table()
    table, out, at = _TABLES[model.key], np.zeros((len(texts), len(model.languages))), 0
    while at < len(texts):
        held, sizes = [], []
        while at < len(texts) and (not sizes or sum(sizes) < _PIECE):
            held.append(grams(_bytes(texts[at]), model.symbol))
            sizes.append(len(held[-1]))
            at += 1
        all_, starts = np.concatenate(held), np.cumsum([0, *sizes[:-1]])
        for k, own in enumerate(table):
            out[at - len(sizes): at, k] = np.add.reduceat(own[all_], starts, dtype=np.float64)
    return out


def predict_column(text: Column, model: Model | None) -> Column:
    """struct(lang, score) of each whole text: ``und`` and 0 for a null text, one without a letter, or without a model."""
    shared = SparkSession.active().sparkContext.broadcast(model)  # at most SYMBOLS**4 counts a language

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            known = [n for n, t in enumerate(batch) if t and own is not None]
            lang, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            if known:
                texts = [batch.iloc[n] for n in known]
                length = bits(own, texts)
                n_bytes = np.array([len(_bytes(t)) for t in texts])
                spare = (length - length.min(axis=1, keepdims=True)) * (np.minimum(n_bytes, EVIDENCE) / n_bytes)[:, None]
                for n, best, p in zip(known, length.argmin(axis=1), 1 / np.exp2(-spare).sum(axis=1)):
                    lang[n], score[n] = own.languages[best], p
            yield pd.DataFrame({"lang": lang, "score": score})

    lettered = F.when(text.rlike(r"\p{L}"), text)
    return of(lettered)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, lang_pred, score): one row for each input row; other columns are not read."""
    out = docs.select("doc_id", predict_column(F.col("text"), model).alias("p"))
    return out.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
