"""Connected components of an edge list, by alternating large-star and small-star steps.

The published two-step contraction (Kiveris et al., "Connected Components in MapReduce and Beyond"):
each step replaces the edges of a node by edges to its smallest neighbour, so every component ends
as a star round its smallest node after a number of rounds that grows with the logarithm of its
diameter. A node's neighbours are never gathered: the minimum is a partial aggregate, joined back to
the edges, where adaptive execution splits a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpark.plans.materialize import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of any integers -> (node, root): root is the smallest node of node's component.

    Nodes without an edge to another node have no row; null ends and self edges are ignored; an empty
    edge list gives an empty result.
    """
    directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    directed = directed.where("u is not null and v is not null and u > v")
    star = materialize(directed.distinct())
    seen = _state(star)
    while seen[0]:
        star = materialize(_small_star(_large_star(star)))
        now = _state(star)
        if now == seen:
            break
        seen = now
    return star.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node u: every larger neighbour is tied to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node u: u and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does: its size and the sums of two of its hashes."""
    row = edges.agg(
        F.count("*"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        F.sum(F.hash("u", "v").cast("long")),
    ).first()
    return tuple(row)
