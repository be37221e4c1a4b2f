"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are compared exactly, never through candidate tables. Distinct fingerprints are laid
out in tiles by their population count; two tiles meet in one task only if their counts differ by no
more than the radius, since each differing bit changes a count by one. In a task the same bound is
applied again to the counts of the four 16-bit words: rows are sorted into cells by those four
counts, cells whose counts differ by more than the radius in total are skipped, and the others are
compared with numpy exclusive-or and bit counts.

Each task reports a spanning forest of what it linked (at most one edge for each fingerprint that it
read), so that a group of thousands of near copies never becomes all its pairs. Texts never move:
only distinct 8-byte fingerprints are shuffled. The number of tile pairs grows with the square of
the number of distinct fingerprints over ``tile_rows``; that is the cost of an exact comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskpark.llm.components import connected_components
from deskpark.plans.materialize import materialize

SEED = 42
BITS = 64
#: Rows of a tile at most (up to the evenness of a hash): bounds a task's memory to a few tens of MB.
TILE_ROWS = 1 << 18
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half the hashes of the shingles.

    Words are runs without ASCII white space of the text with A-Z lower-cased; shingles are ``shingle``
    words joined by a space, repeats included; a shorter text is one shingle; no word gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    ends = ends[shingle - 1:]
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _SLICE):
        spans = zip(starts[at: at + _SLICE].tolist(), ends[at: at + _SLICE].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(count * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int) -> Column:
    """The fingerprint as a signed long; a null text has fingerprint zero."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = np.fromiter((fingerprint(t, shingle) for t in batch), np.uint64, len(batch))
            yield pd.Series(out.view(np.int64))

    return of(text)


def near_duplicates(docs: DataFrame, shingle: int, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp long, component_id): one row for each input row.

    Two rows are linked if their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest doc_id reachable by links, the own one included. Null and empty texts have fingerprint
    zero and are linked like others; repeated rows are linked like others and each keeps its row; null
    ids take part and never become a component_id unless a component has no other id (then it is
    null); an empty table gives an empty result; other columns are not read.
    """
    return _grouped(docs, shingle, radius, tile_rows).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, shingle: int, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fp, text_hash, root, component_id): root is a fingerprint that names the group, also where groups share an id."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint_column(F.col("text"), shingle).alias("fp"))
    rows = materialize(own)
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(linked_pairs(nodes.select("fp"), radius, tile_rows))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def linked_pairs(fingerprints: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct (fp) -> edges (u, v) that connect exactly what links of ``radius`` bits connect."""
    spark = fingerprints.sparkSession
    counted = fingerprints.select("fp", F.bit_count("fp").cast("int").alias("pop"))
    sizes = counted.groupBy("pop").count().collect()  # at most 65 rows
    split = [(r["pop"], -(-r["count"] // tile_rows)) for r in sizes]
    tiles = spark.createDataFrame(split, "pop int, n int")
    tiles = tiles.select("pop", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    left = tiles.select(F.col("pop").alias("p"), F.col("part").alias("i"),
                        F.explode(F.sequence("pop", F.col("pop") + radius)).alias("q"))
    right = tiles.select(F.col("pop").alias("q"), F.col("part").alias("j"))
    pairs = left.join(right, "q").where("p < q or i <= j")
    pairs = pairs.withColumn("pair", F.concat_ws("-", "p", "i", "q", "j"))
    first = pairs.select(F.col("p").alias("pop"), F.col("i").alias("part"), "pair", F.lit(0).alias("side"))
    second = pairs.where("p < q or i < j").select(
        F.col("q").alias("pop"), F.col("j").alias("part"), "pair", F.lit(1).alias("side"))
    parts = F.create_map(*[F.lit(x) for r in split for x in r]) if split else F.create_map(F.lit(0), F.lit(1))
    placed = counted.withColumn("part", F.pmod(F.xxhash64("fp"), parts[F.col("pop")]).cast("int"))
    met = placed.join(first.union(second), ["pop", "part"]).select("pair", "side", "fp")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows.fp[rows.side == k].to_numpy().view(np.uint64) for k in (0, 1)]
        u, v = forest(sides[0], sides[1] if len(sides[1]) else sides[0], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return met.groupBy("pair").applyInPandas(link, "u long, v long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between the rows of two tiles (which may be the same)."""
    nodes = np.unique(np.concatenate([a, b]))
    parent = np.arange(len(nodes))
    a_counts, a, a_cells = _cells(a)
    b_counts, b, b_cells = _cells(b)
    a_at, b_at = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    b_ends = np.append(b_cells[1:], len(b))
    for k, lo in enumerate(a_cells):
        hi = a_cells[k + 1] if k + 1 < len(a_cells) else len(a)
        near = np.abs(b_counts - a_counts[k]).sum(axis=1) <= radius
        from_, sizes = b_cells[near], (b_ends - b_cells)[near]
        if not len(sizes):
            continue
        rows = np.arange(sizes.sum()) + np.repeat(from_ - np.cumsum(sizes) + sizes, sizes)
        step = max(1, (1 << 21) // len(rows))
        others, others_at = b[rows], b_at[rows]
        for at in range(lo, hi, step):
            own = slice(at, min(hi, at + step))
            x, y = np.nonzero(np.bitwise_count(a[own, None] ^ others[None, :]) <= radius)
            _union(parent, a_at[own][x], others_at[y])
    root = _find(parent, np.arange(len(nodes)))
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by the population counts of their 16-bit words: counts of each cell, rows, first row of each cell."""
    counts = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    key = counts.astype(np.int64) @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(key, kind="stable")
    _, starts = np.unique(key[order], return_index=True)
    return counts[order][starts], fps[order], starts


def _find(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = parent[at]
    while not np.array_equal(up, at):
        at, up = up, parent[up]
    return up


def _union(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    while len(x):
        x, y = _find(parent, x), _find(parent, y)
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def one_of_each_group(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """The rows of ``docs`` with all their columns, one document of each group: the smallest doc_id.

    Of several rows of a group with that doc_id the one of the smallest text hash stays, once. Rows that
    share an id but lie in different groups are different documents. Rows with a null id cannot be named and
    stay. Null and empty texts are one group; an empty table gives an empty result.
    """
    from pyspark.sql import Window

    found = _grouped(docs, shingle, radius).where("doc_id = component_id")
    keep = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("keep")).select("keep.*").distinct()
    names = []
    for name in ("text_hash", "_rank"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    text_hash, order = names
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    kept = hashed.join(keep.withColumnRenamed("text_hash", text_hash), ["doc_id", text_hash], "left_semi")
    # Equal rows are limited to one in each task before they are shuffled.
    rank = Window.partitionBy("doc_id", text_hash).orderBy(text_hash)
    kept = kept.withColumn(order, F.row_number().over(rank)).where(F.col(order) == 1)
    return kept.select(docs.columns).union(docs.where("doc_id is null"))
