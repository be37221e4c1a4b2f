"""Shards by a hierarchical weighted hash tree, with DataFrame functions only.

A row descends from the region to the rack to the shard; at each level every child draws
-ln(u) / weight, u a hash of (doc_id, the child's name), and the smallest draw takes the row. A
child's draws depend on nothing but its own name and weight, and a subtree's weight is the sum of its
shards', so a change of weights moves rows only into subtrees that grew or out of those that shrank.
A shard that is added comes as a region of its own: no weight of another subtree changes, and rows
move into the new shard only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskpark.plans.materialize import materialize

#: region -> rack -> (shard, weight)
Tree = list[list[list[tuple[int, float]]]]


def even_tree(regions: int, racks: int, shards: int) -> Tree:
    """Shards numbered from 0 in the order of the tree, all of weight 1."""
    number = iter(range(regions * racks * shards))
    return [[[(next(number), 1.0) for _ in range(shards)] for _ in range(racks)] for _ in range(regions)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return [*tree, [[(1 + max(s for region in tree for rack in region for s, _ in rack), weight)]]]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number of a key; a null key is one key like others. Weights are above zero."""
    weigh = lambda rack: sum(w for _, w in rack)
    regions = [(f"r{i}", sum(map(weigh, region)), i) for i, region in enumerate(tree)]
    racks = [[(f"r{i}k{j}", weigh(rack), j) for j, rack in enumerate(region)] for i, region in enumerate(tree)]
    shards = [[[(f"r{i}k{j}s{s}", w, s) for s, w in rack] for j, rack in enumerate(region)] for i, region in enumerate(tree)]
    name = F.coalesce(key.cast("string"), F.lit(""))

    def draw(children: Column) -> Column:
        def cost(c: Column) -> Column:
            high = F.shiftrightunsigned(F.xxhash64(name, c["name"]), 11)
            return F.struct((-F.log((high + 0.5) / F.lit(float(1 << 53))) / c["weight"]).alias("cost"), c["at"].alias("at"))

        return F.array_min(F.transform(children, cost))["at"]

    return _with(draw(_literal(regions)), lambda r: _with(
        draw(F.get(_nested(racks), r)), lambda k: draw(F.get(F.get(_nested(shards), r), k))))


def _with(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), 0)


def _literal(children: list[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(a).alias("at")) for n, w, a in children])


def _nested(level: list) -> Column:
    return F.array(*[_literal(x) if isinstance(x[0], tuple) else _nested(x) for x in level])


def place(docs: DataFrame, tree: Tree) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, size, text_crc32, shard, slot, grown_shard): one row for each input row.

    size: UTF-8 bytes of the text plus 8; a null text counts none and has the crc of the empty one; slots
    number a shard's rows from 0 without a gap; rows of a repeated or null id share a shard and have slots
    of their own; other columns are not read. Rows are numbered in buckets of a shard, offset by the
    counts of the buckets before (one small row for each shard and bucket), never in one task a shard.
    """
    text, buckets = F.coalesce("text", F.lit("")), max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size, crc = (F.octet_length(text) + 8).cast("long"), F.crc32(text)
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), tree)).withColumn("bucket", bucket)
    rows = materialize(rows.withColumn("grown_shard", shard_of(F.col("doc_id"), grown(tree))))
    counts = rows.groupBy("shard", "bucket").count()  # shards times buckets rows at most
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("n", F.row_number().over(own) - 1).join(F.broadcast(before), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("n") + F.col("before")).cast("long").alias("slot"), "grown_shard")
