"""Whitening against a dense eigen-decomposition, the bidiagonal solver on hard matrices, edge rows."""

import math
import random

import numpy as np
import pytest

from deskpark.llm import bidiagonal as b
from deskpark.llm import whitening as w
from deskpark.llm.queries import queries
from llm.cases import SF_SMALL

VECTORS = "vec_id long, embedding array<float>, label int, n long, component string, _y double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 0.5) for i, v in rows], VECTORS).repartition(3)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, k=4):
    """{vec_id: (n, exact deviation)}, eigenvalues, eigenvectors, whitened rows up to sign."""
    held = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if usable(v)]
    fit = sorted({tuple(x) for _, x in held})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in held]
    white = (np.array([x for _, x in held], float) - np.array([s / n for s in sums])) @ basis / np.sqrt(values)
    return n, deviation, values / (centred ** 2).sum() * n, white


def check(got, rows, k=4):
    n, deviation, explained, white = brute(rows, k)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == k * len(deviation) and {r.n for r in got} == {n}
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(deviation)
    assert all(str(r.deviation) == r.deviation_exact for r in got)
    for c in range(k):
        assert {round(r.explained, 12) for r in got if r.component == c + 1} == {round(explained[c], 12)}
        first = max(range(len(deviation)), key=lambda j: abs(white[j, c]))
        sign = math.copysign(1, white[first, c] * by[deviation[first][0], c + 1][0].whitened)
        for (i, _), v in zip(deviation, white[:, c]):
            assert any(abs(r.whitened - sign * v) < 1e-9 for r in by[i, c + 1])
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check(queries()["op11_whitening"](spark, SF_SMALL).collect(), rows)


def test_repeated_null_and_odd_vectors(spark):
    rng = random.Random(3)
    plain = [(i, [rng.gauss(0, s) for s in (3, 2, 1, 0.5, 0.1)]) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 2.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [])]
    copies = [(200 + i, plain[0][1]) for i in range(300)] + [(5, plain[5][1])]  # a hot vector and a repeated row
    check(w.whiten(vectors(spark, plain + odd + copies)).collect(), plain + odd + copies)
    other = vectors(spark, [*plain, (300, [1.0, 2.0])])  # another length is left out
    check(w.whiten(other).collect(), plain)


def test_fewer_directions_than_components(spark):
    rng = random.Random(4)
    line = [(i, [float(t), float(-t), 2.0 * t]) for i, t in ((i, rng.randint(-9, 9)) for i in range(40))]
    got = w.whiten(vectors(spark, line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 40 and got[0].explained == pytest.approx(1)
    assert w.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert w.whiten(vectors(spark, [])).collect() == [] and w.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []


def test_deviation_beyond_a_long_stays_exact(spark):
    rows = [(1, [3e13, 1.0]), (2, [-2.5e13, 0.25]), (3, [7.0, -1e13]), (None, [7.0, 5.0])]
    got = {r.vec_id: r for r in w.whiten(vectors(spark, rows)).where("component = 1").collect()}
    _, deviation, _, _ = brute(rows, 2)
    assert {i: int(r.deviation_exact) for i, r in got.items()} == dict(deviation)
    assert all(r.deviation is None for r in got.values())


def test_many_tasks_fold_into_one_factor(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(c) for c in rng.normal(size=6)]) for i in range(3000)]
    df = vectors(spark, rows).repartition(40)
    found, length = w.grid_rows(df)
    spread = found.select(w.F.col("_x").alias("x")).distinct().repartition(40)
    n, sums = w._sums(spread, length)
    r = w._triangle(spread, n, sums)
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows], float)
    x -= np.array(sums) / n
    assert np.allclose(r.T @ r, x.T @ x, rtol=1e-12)


rng = np.random.default_rng(0)
LEFT, RIGHT = (np.linalg.qr(rng.normal(size=(40, 40)))[0] for _ in range(2))
HARD = {
    "random": rng.normal(size=(40, 40)), "one": np.array([[3.0]]), "two": rng.normal(size=(2, 2)), "identity": np.eye(9),
    "equal": LEFT @ np.diag(1 + 1e-14 * rng.normal(size=40)) @ RIGHT, "pairs": LEFT @ np.diag(np.repeat(np.arange(20, 0, -1.0), 2)) @ RIGHT,
    "nearly pairs": LEFT @ np.diag(np.repeat(np.arange(20, 0, -1.0), 2) + 1e-9 * rng.normal(size=40)) @ RIGHT,
    "graded": LEFT @ np.diag(10.0 ** -np.arange(40)) @ RIGHT,
    "wilkinson": np.linalg.cholesky(np.diag(np.abs(np.arange(-10, 11.0)) + 3) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T,
}


@pytest.mark.parametrize("name", HARD)
def test_solver(name):
    m = HARD[name]
    values, vecs = b.largest(m, 4)
    k = min(4, len(m))
    assert np.allclose(values, np.linalg.svd(m, compute_uv=False)[:k] ** 2, rtol=1e-13)
    assert np.abs(vecs.T @ vecs - np.eye(k)).max() < 1e-13
    assert np.abs(m.T @ (m @ vecs) - vecs * values).max() < 1e-13 * values[0]


def test_dqds_finds_tiny_values_to_full_relative_accuracy():
    """The values of a bidiagonal matrix are determined by its entries to relative accuracy; their product is that of the diagonal."""
    d, f = 10.0 ** -np.arange(15), 10.0 ** -np.arange(0.5, 14, 1)
    values = b.dqds(d ** 2, f ** 2)
    assert values.min() < 1e-28 and np.sum(np.log(values)) == pytest.approx(np.sum(np.log(d ** 2)), rel=1e-13)
    assert b.dqds(np.array([4.0, 9.0, 1.0]), np.zeros(2)).tolist() == [9.0, 4.0, 1.0]
