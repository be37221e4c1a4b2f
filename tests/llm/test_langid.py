"""PPM language id: code lengths against a tree walked byte by byte, held-out accuracy, edge rows."""

import zlib
from collections import Counter
from math import log2

import numpy as np

from deskpark.llm import langid
from deskpark.llm.queries import queries
from llm.cases import EDGE


def walked_bits(text, model, k):
    """Code length of a text: for each byte, escape from the longest context down to the one that has seen it."""
    S = langid.SYMBOLS
    trees = [Counter() for _ in range(langid.ORDER + 1)]
    for g, n in zip(model.gram[model.owner == k].tolist(), model.count[model.owner == k].tolist()):
        for order in range(langid.ORDER + 1):
            trees[order][g % S ** (order + 1)] += n
    followers = [{} for _ in trees]
    for order, tree in enumerate(trees):
        for g, n in tree.items():
            followers[order].setdefault(g // S, Counter())[g % S] += n
    total = 0.0
    for g in langid.grams(text.encode(), model.symbol).tolist():
        for order in range(langid.ORDER, -1, -1):
            seen = followers[order].get(g % S ** (order + 1) // S)
            if seen:
                n, q = sum(seen.values()), len(seen)
                if g % S in seen:
                    total -= log2(seen[g % S] / (n + q))
                    break
                total -= log2(q / (n + q))
        else:
            total += log2(S)
    return total


def test_code_lengths_equal_a_walked_tree(make):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("le chat et la souris", "fr")] * 6)]
    model = langid.train(make(rows))
    assert model.languages == ["en", "fr"]
    for text in ("the rat", "la vie", "Z9é\x00", "the the the"):
        got = langid.bits(model, [text])[0]
        assert np.allclose(got, [walked_bits(text, model, k) for k in range(2)], rtol=1e-5)


def test_learns_only_from_rows_that_may_be_learned_from(make):
    rows = [(i, "abc", "en") if zlib.crc32(str(i).encode()) % 3 != 1 else (i, "xyz xyz", "zz") for i in range(30)]
    assert langid.train(make(rows)).languages == ["en"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op1_ppm_langid"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 250 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows_and_empty_table(make, edge, empty):
    model = langid.train(make([(i, "some words of text", "en") for i in range(9)]))
    got = sorted((r.doc_id or -1, r.lang_pred) for r in langid.predict(edge, model).collect())
    assert got == sorted((d or -1, "en" if any(c.isalpha() for c in t or "") else "und") for d, t in EDGE)
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.predict(edge, None).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    assert langid.train(make([(0, None, "en"), (2, "x", None), (None, "x", "en")])) is None
