"""SimHash near-dedup against brute force: fingerprints by definition, components by all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from deskpark.llm import components, simhash
from deskpark.llm.queries import queries
from llm.cases import EDGE, SF_SMALL


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius):
    """(doc_id, fp) -> component of each row, by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            if (a[1] ^ rows[j][1]).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(rows))]


def test_query_equals_brute_force(spark):
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries()["op2_simhash"](spark, SF_SMALL).collect())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = [(d, brute_fingerprint(docs[d])) for d in sorted(docs)]
    assert got == [(d, f, c) for (d, f), c in zip(rows, brute_components(rows, 4))]


def test_edge_rows(edge):
    key = lambda x: tuple((v is not None, v) for v in x)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(edge, 4, 4).collect()), key=key)
    rows = [(d, brute_fingerprint(t)) for d, t in EDGE if len(t or "") < 1000]
    long = simhash.fingerprint(EDGE[5][1], 4)
    rows = sorted([*rows, (5, long), (6, long)], key=key)
    assert got == sorted([(d, f, c) for (d, f), c in zip(rows, brute_components(rows, 4))], key=key)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty, 4, 4).count() == 0
    assert simhash.one_of_each_group(empty, 4, 4).count() == 0


def test_one_of_each_group_keeps_the_columns_and_one_row(edge):
    kept = simhash.one_of_each_group(edge, 4, 4)
    assert kept.columns == edge.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert ids == [1, 4, 5, 7, 8, 9]  # 1, 2, 3 have no word; 5 and 6 are copies; 7 is there twice
    assert sum(r.doc_id is None for r in kept.collect()) == 1


@pytest.mark.parametrize("tile_rows", [7, 1 << 18])
def test_tiles_lose_no_link(spark, tile_rows):
    """Random fingerprints and chains of near ones, in tiles of any size."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for fp in list(fps)[:40]:
        for _ in range(6):
            for _ in range(rng.randint(1, 5)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.linked_pairs(spark.createDataFrame(signed, "fp long"), 4, tile_rows)
    roots = {r.node: r.root for r in components.connected_components(edges).collect()}
    mine = [roots.get(s[0], s[0]) for s in signed]
    brute = brute_components(list(enumerate(fps)), 4)
    assert len(set(zip(mine, brute))) == len(set(mine)) == len(set(brute))


def test_forest_reports_no_more_edges_than_rows():
    base = np.uint64(0x123456789ABCDEF)
    near = np.unique(np.array([base ^ np.uint64((1 << i) | (1 << j)) for i in range(64) for j in range(i)], np.uint64))
    u, v = simhash.forest(near, near, 4)
    assert len(u) == len(near) - 1 and len(set(v.tolist())) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_rows_that_share_an_id_but_not_a_group_are_different_documents(make):
    a = "the old mill by the river was built in the year of the great flood and stands there still today"
    b = "every child of the village learns to swim before it is six since the water is never far from home"
    kept = lambda rows: sorted((r.doc_id, r.text) for r in simhash.one_of_each_group(make(rows), 4, 4).collect())
    assert kept([(3, b), (5, a), (5, b)]) == [(3, b), (5, a)]
    assert kept([(5, a), (5, b), (5, b), (9, a)]) == [(5, b), (5, a)]
    assert kept([(2, a), (2, a), (2, a), (7, a)]) == [(2, a)]
