"""Plan helpers and retrieval against brute force on small inputs."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from deskpark.operators import retrieval as RT
from deskpark.plans.ids import dense_ids
from deskpark.plans.ranks import rank_in_groups


def test_ranks_in_a_hot_group_equal_a_global_ranking(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(6000):
        g = None if i % 50 == 0 else 0 if i % 3 else rnd.randrange(1, 40)  # group 0 holds two thirds of the rows
        rows.append((g, "x" if i % 2 else None, i, rnd.choice([None, rnd.randrange(50)])))
    df = spark.createDataFrame(rows, "g int, h string, id int, v int").repartition(5)
    order = [F.col("v").desc_nulls_first(), F.col("id").desc()]
    got, sizes = rank_in_groups(df, ["g", "h"], order, partitions=16)
    w = Window.partitionBy("g", "h")
    want = df.withColumn("rn", F.row_number().over(w.orderBy(*order)))
    cols, key = ["g", "h", "id", "rn"], repr
    assert sorted(map(tuple, got.select(cols).collect()), key=key) == sorted(map(tuple, want.select(cols).collect()), key=key)
    counts = df.groupBy("g", "h").count()
    assert sorted(map(tuple, sizes.collect()), key=key) == sorted(map(tuple, counts.collect()), key=key)


def test_dense_ids_follow_the_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(100), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "ts int, k int").repartition(7)
    got = dense_ids(df, ["ts", "k"], F.lit(1000), "id", partitions=5).collect()
    want = {(ts, k): 1000 + i + 1 for i, (ts, k) in enumerate(sorted(rows))}
    assert {(r.ts, r.k): r.id for r in got} == want


@pytest.mark.parametrize("n,partitions", [(200_000, 8), (1_000_000, 200)])
def test_dense_ids_of_many_rows(spark, n, partitions):
    rows = spark.range(n).select((F.xxhash64("id") % 1000).alias("ts"), F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("payload"))
    got = dense_ids(rows, ["ts", "k"], F.lit(50), "new", partitions=partitions)
    out = got.agg(F.count("*"), F.count_distinct("new"), F.min("new"), F.max("new")).first()
    assert tuple(out) == (n, n, 51, 50 + n)
    w = Window.partitionBy(F.floor((F.col("new") - 51) / 1000)).orderBy("new")  # neighbours, block by block
    before = F.lag(F.struct("ts", "k")).over(w)
    assert got.withColumn("before", before).where("before is not null and not before < struct(ts, k)").count() == 0


def _bm25_python(docs, questions, k=5, k1=1.2, b=0.75):
    tok = lambda s: [t for t in re.split(r"[^\w]+|_", s.lower()) if t]
    dt = {d: tok(t) for d, t in docs}
    n, avgdl = len(dt), sum(len(v) for v in dt.values()) / len(dt)
    df = {}
    for toks in dt.values():
        for t in set(toks):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in questions:
        scores = {}
        for t in set(tok(text)):
            if t not in df:
                continue
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            for d, toks in dt.items():
                tf = toks.count(t)
                if tf:
                    norm = k1 * (1 - b + b * len(toks) / avgdl)
                    scores[d] = scores.get(d, 0.0) + idf * tf * (k1 + 1) / (tf + norm)
        ranked = sorted(((round(s, 6), d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
        out[q] = [(d, s) for s, d in ranked]
    return out


def test_bm25_top_k_equals_python_scorer(spark):
    docs = [(1, "La impresora no imprime. Error de red"), (2, "Cómo cambiar la contraseña del portal"),
            (3, "Error 500 en el portal de pagos; el portal no carga"), (4, "Reportes lentos en el portal"),
            (5, "impresora impresora impresora"), (6, "Nada que ver"), (7, "pagos rechazados error")]
    questions = [(10, "el portal da error"), (11, "impresora"), (12, "¿contraseña?"), (13, "zzz")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(questions, "conv_id bigint, q string")
    got = {}
    for r in RT.kb_topk(d, q).orderBy("conv_id", "rank").collect():
        got.setdefault(r.conv_id, []).append((r.doc_id, r.score))
    want = {k: v for k, v in _bm25_python(docs, questions).items() if v}
    assert got == want
    assert [r.conv_id for r in RT.kb_unanswered(d, q).collect()] == [13]


def test_bm25_top_k_over_many_blocks_makes_no_row_per_pair(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = ["the " + " ".join(rnd.choices(words, [1 / (i + 1) for i in range(60)], k=rnd.randrange(1, 40))) for _ in range(300)]
    docs = [(i, texts[i % 250]) for i in range(400)]  # copies: equal scores go by doc_id
    questions = [(i, "The " + " ".join(rnd.sample(words, 6)) + " unknown") for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(questions, "conv_id bigint, q string")
    for k in (1, 5, 90):
        top, got = RT.kb_topk(d, q, k), {}
        for r in top.orderBy("conv_id", "rank").collect():
            got.setdefault(r.conv_id, []).append((r.doc_id, r.score))
        want = _bm25_python(docs, questions, k)
        assert {x: [d for d, _ in v] for x, v in got.items()} == {x: [d for d, _ in v] for x, v in want.items()}
        assert all(abs(a[1] - b[1]) < 2e-6 for x in want for a, b in zip(got[x], want[x]))
    joins = [x for x in top._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert joins and all("qid" in x for x in joins), joins  # no join by term


def test_bm25_scores_only_documents_that_can_reach_the_floor(spark, monkeypatch):
    """The k-th best of the first documents is a floor: blocks send on few others, and the best are those of all pairs."""
    monkeypatch.setattr(RT, "BLOCK_POSTINGS", 400)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    odds = [1 / (i + 3) for i in range(400)]
    docs = [(i, "the " + " ".join(rnd.choices(words, odds, k=rnd.randrange(5, 60)))) for i in range(900)] + [(900 + i, "the " * 300 + f"w{i}") for i in range(9)]
    questions = [(i, "The " + " ".join(rnd.choices(words, odds, k=rnd.randrange(1, 25)))) for i in range(40)]
    questions += [(50, "the"), (51, "the w0"), (52, "w399 w398"), (53, " ".join(words)), (54, "unknown"), (55, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(questions, "conv_id bigint, q string")
    want = {x: v for x, v in _bm25_python(docs, questions, 5).items() if v}
    for steps in (RT.STEPS, 0.3):  # few steps: more documents are scored, the best stay
        monkeypatch.setattr(RT, "STEPS", steps)
        got = {}
        for r in RT.kb_topk(d, q).orderBy("conv_id", "rank").collect():
            got.setdefault(r.conv_id, []).append((r.doc_id, r.score))
        assert {x: [d for d, _ in v] for x, v in got.items()} == {x: [d for d, _ in v] for x, v in want.items()}
        assert all(abs(a[1] - b[1]) < 2e-6 for x in want for a, b in zip(got[x], want[x]))
    asked, best = RT.bm25_best(d, q, 5)
    assert spark.sparkContext.defaultParallelism >= 2 and asked.count() == len(want)
    assert best.count() < 150 * len(want), best.count()  # 5 of each question and block were more


def test_bm25_of_repeated_and_null_keys(spark):
    """Rows of one doc_id are one document, rows of one question key one question, asked as often as it comes."""
    docs = [(1, "red bolt"), (1, "red red nut"), (None, "nut bolt"), (None, "bolt"), (2, None), (3, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    q = spark.createDataFrame([(7, "red bolt"), (7, "red nut"), (None, "bolt")], "conv_id bigint, q string")
    n, avgdl, dl = 6, 8 / 5, {1: 3, None: 2}
    tf = {1: {"red": 3, "bolt": 1, "nut": 1}, None: {"nut": 1, "bolt": 2}}

    def weight(term, doc):
        df = sum(term in t for t in tf.values())
        f = tf[doc].get(term, 0)
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl[doc] / avgdl))
    got = {(r.conv_id, r.doc_id): r.score for r in RT.kb_topk(d, q).collect()}
    want = {(7, x): 2 * weight("red", x) + weight("bolt", x) + weight("nut", x) for x in tf} | {(None, x): weight("bolt", x) for x in tf}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_context_joins_texts_of_the_best_documents_only(spark):
    docs = [(i, f"common text {i}") for i in range(200)] + [(500, "rare common")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    q = spark.createDataFrame([(1, "rare"), (2, "common"), (3, "zzz")], "conv_id bigint, q string")
    out = RT.kb_context(d, q)
    assert {r.conv_id: (r.n_docs, r.context) for r in out.collect()} == {
        1: (1, "rare common"), 2: (5, "\n\n".join(["rare common", *(f"common text {i}" for i in range(4))])), 3: (0, "")}
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("term" in x for x in joins), joins


def test_context_sends_no_text_per_question_and_keeps_every_row(spark):
    docs = [(1, "red bolt"), (1, "bolt anew"), (1, None), (2, "bolt bolt"), (3, ""), (None, "bolt"), *((i, f"nut {i}") for i in range(10, 40))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame([(1, 0, "bolt"), (1, 0, "bolt"), (1, 1, "red"), (2, 0, "zzz"), (None, 0, "bolt"), (3, 0, None)],
                              "conv_id bigint, turn bigint, q string")
    out = RT.kb_context(d, q)
    got = sorted(((r.conv_id, r.turn), r.n_docs, r.context) for r in out.collect() if r.conv_id is not None)
    of_1 = "bolt anew\n\nred bolt"
    both = f"{of_1}\n\nbolt bolt"  # equal scores: the smaller id first
    assert got == [((1, 0), 4, both), ((1, 0), 4, both), ((1, 1), 3, of_1), ((2, 0), 0, ""), ((3, 0), 0, "")]
    assert [(r.n_docs, r.context) for r in out.where("conv_id is null").collect()] == [(0, "")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("collect_list" in x and "text" in x for x in plan.splitlines()), plan


def test_documents_are_indexed_where_they_lie_and_repeated_ids_merged(spark, monkeypatch):
    docs = [(i % 7 if i < 14 else i, f"word{i % 5} word{i % 3} w{i}") for i in range(60)] + [(None, "a b"), (None, "b c"), (3, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)

    def rows(df):
        out = {}
        for r in df.collect():
            data = zlib.decompress(bytes(r.packed))
            counts = np.frombuffer(data, "<u4", r.n_terms).tolist()
            assert r.doc_id not in out
            out[r.doc_id] = (r.n_rows, r.n_texts, r.n_tokens, r.dl, dict(zip(data[4 * r.n_terms:].decode().split(" "), counts)))
        return out

    few = rows(RT.doc_index(d))
    monkeypatch.setattr(RT, "REPEATED_ROWS", 1)
    assert few == rows(RT.doc_index(d)) and len(few) == 54
    assert few[3] == (3, 2, 6, 3, {"word3": 1, "word0": 2, "w3": 1, "w10": 1, "word1": 1}), few[3]
    alone = RT.doc_index(d.where("doc_id >= 14"))
    assert alone.rdd.getNumPartitions() == d.rdd.getNumPartitions()  # not shuffled


def test_marks_hold_every_value_and_few_others(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(300)] + [("año",), (None,)], "term string")
    marked = RT._marks(F.col("term"), words)
    has = lambda t: marked[(x := zlib.crc32(t.encode()) % RT.MARKS) >> 3] >> (x & 7) & 1
    assert len(marked) == RT.MARKS // 8 and all(has(f"w{i}") for i in range(300)) and has("año")
    assert sum(has(f"other{i}") for i in range(1000)) < 10
