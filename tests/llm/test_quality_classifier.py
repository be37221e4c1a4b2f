"""FTRL classifier: updates against a plain rendering, held-out accuracy, edge rows."""

import math
from collections import Counter, defaultdict

import numpy as np

from deskpark.llm import quality_classifier as q
from deskpark.llm.queries import queries
from llm.cases import EDGE


def plain_ftrl(seen, bits, alpha=0.3, beta=1.0, l1=0.02, l2=0.5, epochs=3):
    z, n, bias = defaultdict(float), defaultdict(float), 1 << bits

    def weight(i):
        if i == bias:
            return -z[i] / ((beta + math.sqrt(n[i])) / alpha + 1e-6)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for at, value, y in seen:
            x = [*zip(at.tolist(), value.tolist()), (bias, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_updates_equal_plain_ftrl():
    texts = [("good words here and there", 1), ("bad!! bad!! bad!!", 0), ("more good words", 1), ("", 0), (None, 1)] * 5
    seen = [(*q.features(t, 12), y) for t, y in texts]
    model, plain = q.fit_features(seen, 12), plain_ftrl(seen, 12)
    assert abs(model.bias - plain[1 << 12]) < 1e-6
    assert all(abs(model.weights[i] - w) < 1e-5 for i, w in plain.items() if i < 1 << 12)


def test_features_count_words_and_neighbours(monkeypatch):
    text = "a b c a b d d d , . e"
    whole = q.features(text, 20)
    monkeypatch.setattr(q, "_SLICE", 3)
    sliced = q.features(text, 20)
    assert np.array_equal(whole[0], sliced[0]) and np.allclose(whole[1], sliced[1])
    tokens = text.split()
    pairs = ["=" if x == y else (x, y) for x, y in zip(tokens, tokens[1:])]
    counts = Counter(tokens) + Counter(pairs)
    assert np.allclose(sorted(whole[1] / whole[1].min()), sorted(counts.values()))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op7_quality_classifier"](spark, sf).where("held_out")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 100 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_edge_rows_and_empty_tables(spark, edge, empty):
    kind = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 0, 0), (7, 1, 0), (2, None, 0), (None, 1, 0), (99, 1, 1)], kind)
    model = q.train(edge, labels)
    got = q.classify(edge, model).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(d or -1 for d, _ in EDGE)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    none = q.train(empty, spark.createDataFrame([], kind))
    assert {r.score for r in q.classify(edge, none).collect()} == {0.5}
    assert q.classify(empty, none).count() == 0
    assert q.keep_good(edge, none).count() == edge.count()
