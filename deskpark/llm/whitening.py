"""Embedding whitening by blockwise QR, bidiagonalisation, dqds and twisted factorisations.

Vectors are made integers, x = floor(256 c), and each distinct x is fitted once. Every task centres its
rows and folds them, a block at a time, into one triangular factor; the factors of all tasks are folded
into one by rounds of ``FAN`` to a task, so that a single square of the vectors' length reaches the
driver, however many rows there are. ``bidiagonal`` finds the leading singular values and directions.
All rows are then projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskpark.llm import bidiagonal
from deskpark.plans.materialize import materialize

GRID = 256
#: Triangular factors that one task folds into one.
FAN = 16
#: A direction whose singular value is less than this share of the largest is rounding, not a component.
RANK = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors of per-dimension sums S; eigenvalues and unit eigenvectors (columns) of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _grid(column: str) -> Column:
    """floor(256 c) of each entry; null if the vector is null or empty or holds null or non-finite entries."""
    entry = F.col(column)
    whole = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(entry, lambda c: F.floor(F.lit(float(GRID)) * c.cast("double")))
    return F.when(whole & (F.size(entry) > 0), x)


def _layout(x: DataFrame) -> tuple[int, str] | None:
    """(length, narrowest integer type) of the commonest length of x (ties: the longest); None without rows."""
    row = (x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low"))
           .orderBy(F.desc("n"), F.desc("d")).first())
    if row is None:
        return None
    most = max(row.high, -row.low - 1)
    return row.d, "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"


def grid_rows(rows: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(rows that have a vector, with the integer vector as _x, its length).

    Vectors of another length than the commonest are left out. Entries beyond the range of a long are
    taken at its end. ``_x`` is held in the narrowest integers, so that it is shuffled and stored small.
    """
    named = rows.withColumn("_x", _grid(column)).where("_x is not null")
    layout = _layout(named.select(F.col("_x").alias("x")))
    if layout is None:
        return named, 0
    length, kind = layout
    return named.where(F.size("_x") == length).withColumn("_x", F.col("_x").cast(f"array<{kind}>")), length


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64) if len(vectors) else np.zeros((0, 0), np.int64)


def _sums(fitted: DataFrame, length: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of each dimension, in one pass."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * length
        for batch in batches:
            x = _matrix(batch["x"])
            if len(x) and (x.max() >= 1 << 50 or x.min() <= -(1 << 50)):
                x = x.astype(object)  # a sum of a batch would not fit into 64 bits
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0))] if len(x) else total
        yield pd.DataFrame({"at": range(length), "n": n, "s": [str(t) for t in total]})

    parts = fitted.mapInPandas(task, "at int, n long, s string")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    return int(found[0].n), [int(r.s) for r in found]


def _fold(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def _triangle(fitted: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangular factor R of all centred vectors: blocks in each task, then rounds of ``FAN`` factors."""
    length, mean = len(sums), np.array([s / n for s in sums])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held, waiting = np.zeros((0, length)), []
        for batch in batches:
            waiting.append(_matrix(batch["x"]).reshape(-1, length) - mean)
            if sum(map(len, waiting)) >= 4 * length:
                held, waiting = _fold([held, *waiting]), []
        held = _fold([held, *waiting]) if waiting else held
        if len(held):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [held.astype("<f8").tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((0, length))
        for data in group.sort_values("part")["r"]:
            held = _fold([held, np.frombuffer(data, "<f8").reshape(-1, length)])
        return pd.DataFrame({"part": [int(group["part"].min()) // FAN], "r": [held.tobytes()]})

    factors, kind = materialize(fitted.mapInPandas(task, "part int, r binary")), "part int, r binary"
    most = factors.agg(F.max("part")).first()[0]
    while most > 0:
        factors = materialize(factors.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merge, kind))
        most //= FAN
    r = np.frombuffer(factors.first().r, "<f8").reshape(-1, length)
    return np.concatenate([r, np.zeros((length - len(r), length))]) if len(r) < length else r


def fit(rows: DataFrame, column: str = "embedding", components: int = 4) -> Whitening | None:
    """Fits the distinct vectors of ``rows``; None if there is no vector."""
    fitted, length = grid_rows(rows, column)
    if not length:
        return None
    fitted = materialize(fitted.select(F.col("_x").alias("x")).distinct())
    n, sums = _sums(fitted, length)
    r = _triangle(fitted, n, sums)
    values, vectors = bidiagonal.largest(r, components)
    real = values > RANK * RANK * (values[0] if len(values) else 0)
    model = Whitening(n, sums, values[real] / n, vectors[:, real], float((r * r).sum()) / n)
    return Whitening(n, sums, model.values, model.vectors, model.trace, _identity_error(fitted, model))


def _white(x: np.ndarray, model: Whitening) -> np.ndarray:
    return (x - model.mean) @ model.vectors / np.sqrt(model.values)


def _identity_error(fitted: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened covariance minus the identity, over the fitted vectors."""
    k = len(model.values)
    if not k:
        return None

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(_white(_matrix(batch["x"]), model), columns=[f"w{i}" for i in range(k)])

    white = fitted.mapInPandas(task, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def transform(rows: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, vector, ...) -> one row for each vector and component, by the model of ``fit``.

    Columns: key, component, n, deviation, deviation_exact, whitened, explained, identity_error. Rows whose
    vector is null, empty, of another length than the model's or holds null or non-finite entries have
    none; null and repeated keys are kept, as are equal vectors; directions without variance are no
    components, so fewer than asked for may be returned, and none for a single vector. ``deviation`` is
    null where it does not fit into a long; ``deviation_exact`` always holds it. Other columns are not read.
    """
    kind = dict(rows.dtypes)[key]
    schema = "at string, component int, n long, deviation_exact string, whitened double, explained double"
    if model is None or not len(model.values):
        out = rows.sparkSession.createDataFrame([], schema)
    else:
        length, k = len(model.sums), len(model.values)
        share = model.values / model.trace

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.array(model.sums, object)
            most_sum = max(abs(s) for s in model.sums)
            for batch in batches:
                x = _matrix(batch["_x"]).reshape(-1, length)
                if not len(x):
                    continue
                # (n x - S)^2 summed fits into 64 bits, or is computed with Python's integers.
                most = model.n * max(int(x.max()), -int(x.min())) + most_sum
                exact = most * most * length < 1 << 63
                away = model.n * x - np.array(model.sums, np.int64) if exact else model.n * x.astype(object) - sums
                deviation = [str(v) for v in (away * away).sum(axis=1)]
                yield pd.DataFrame({
                    "at": np.repeat(batch["at"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": model.n,
                    "deviation_exact": np.repeat(np.array(deviation, object), k), "whitened": _white(x, model).ravel(), "explained": np.tile(share, len(x))})

        own = rows.withColumn("_x", _grid(column)).where(F.size("_x") == length)
        out = own.select(F.col(key).cast("string").alias("at"), "_x").mapInPandas(task, schema)
    return out.select(
        F.col("at").cast(kind).alias(key), "component", "n", F.col("deviation_exact").try_cast("bigint").alias("deviation"),
        "deviation_exact", "whitened", "explained", F.lit(model.identity_error if model else None).cast("double").alias("identity_error"))


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 4) -> DataFrame:
    """Fits the distinct vectors of ``rows`` and projects every row; see ``transform``."""
    return transform(rows, fit(rows, column, components), key, column)
