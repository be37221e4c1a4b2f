"""The hash tree against plain draws, its law, weights, slots, edge rows."""

import struct
import zlib
from collections import Counter
from math import log

import xxhash
from pyspark.sql import functions as F

from deskpark.llm import sharding as s
from deskpark.llm.queries import queries
from llm.cases import EDGE, SF_SMALL


def plain_shard(key, tree):
    """The same descent, draw by draw; a hash of two texts continues from the hash of the first."""

    def draw(children):
        def cost(name, weight):
            first = xxhash.xxh64_intdigest(("" if key is None else str(key)).encode(), 42)
            return -log(((xxhash.xxh64_intdigest(name.encode(), first) >> 11) + 0.5) / (1 << 53)) / weight
        return min((cost(n, w), at) for n, w, at in children)[1]

    weigh = lambda rack: sum(w for _, w in rack)
    r = draw([(f"r{i}", sum(map(weigh, x)), i) for i, x in enumerate(tree)])
    k = draw([(f"r{r}k{j}", weigh(x), j) for j, x in enumerate(tree[r])])
    return draw([(f"r{r}k{k}s{n}", w, n) for n, w in tree[r][k]])


def check(rows, texts, tree):
    """texts: the multiset of (doc_id, text)."""
    bytes_of = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len(bytes_of(t)) + 8, zlib.crc32(bytes_of(t))) for d, t in texts)
    assert all(r.shard == plain_shard(r.doc_id, tree) and r.grown_shard == plain_shard(r.doc_id, s.grown(tree)) for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows = queries()["op9_sharding"](spark, SF_SMALL).collect()
    check(rows, docs, s.even_tree(3, 2, 4))
    assert {r.law for r in rows} == {"key"}


def test_edge_rows_and_empty_table(edge, empty):
    tree = [[[(0, 1.0), (1, 2.5)], [(2, 1.0)]], [[(3, 4.0)]]]
    check(s.place(edge, tree).collect(), EDGE, tree)
    assert s.place(empty, tree).count() == 0


def test_shares_follow_weights_and_growth_moves_rows_into_the_new_shard_only(spark):
    tree = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 2.0)]]]
    heavier = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 4.0)]]]
    ids = spark.range(40_000)
    rows = ids.select(*[s.shard_of(F.col("id"), t).alias(n) for n, t in (("old", tree), ("new", s.grown(tree, 2.0)), ("heavy", heavier))]).collect()
    share = Counter(r.old for r in rows)
    assert all(abs(share[k] / 40_000 - w / 8) < 0.015 for k, w in enumerate((1, 3, 2, 2)))
    assert all(r.new in (r.old, 4) for r in rows) and abs(sum(r.new == 4 for r in rows) / 40_000 - 0.2) < 0.015
    assert all(r.heavy in (r.old, 3) for r in rows)
