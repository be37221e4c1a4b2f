"""Ranks within groups of any size, without a window that holds a group.

``row_number() over (partition by g order by o)`` sorts a whole group in one
task, and a page far down a hot group needs all rows before it. Instead the
rows are range-partitioned and sorted by ``(g, o)``, so that a hot group lies
over many partitions, marked with ``monotonically_increasing_id`` and written
once under ``spark.checkpoint.dir``. One small row for each partition and
group in it (its first mark and its count) then gives every row its rank: mark
- first mark + rows of the group in earlier partitions + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskpark.plans.ids import PARTITION_BITS
from deskpark.plans.materialize import materialize


def rank_in_groups(df: DataFrame, group_cols: list[str], order_cols: list[Column], rank_col: str = "rn",
                   partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with its rank from 1 in each group, and ``(group_cols, n)`` with each group's size.

    ``order_cols`` must be a total order (end with a unique key). Group columns may be NULL; they must
    not need more than a join to compare (no arrays or maps).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in group_cols] + order_cols
    held = materialize(df.repartitionByRange(n, *by).sortWithinPartitions(*by)
                       .withColumn("_mark", F.monotonically_increasing_id()))
    held = held.withColumn("_pid", F.shiftright("_mark", PARTITION_BITS))
    pieces = held.groupBy("_pid", *group_cols).agg(F.min("_mark").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    named = pieces.select(F.col("_pid").alias("_pid2"), "_first", "_off", *[F.col(c).alias(f"_g_{c}") for c in group_cols])
    same = F.col("_pid") == F.col("_pid2")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    ranked = held.join(named, same).select(
        *df.columns, (F.col("_mark") - F.col("_first") + F.col("_off") + 1).alias(rank_col))
    sizes = pieces.groupBy(*group_cols).agg(F.sum("_n").alias("n"))
    return ranked, sizes
