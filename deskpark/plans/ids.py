"""Dense, ordered ids for appended rows without a single-partition window.

``row_number() over (order by o)`` puts every row in one task. Instead the
rows are range-partitioned and sorted by ``o`` (a distributed sort), marked
with ``monotonically_increasing_id`` and written once as a reliable checkpoint
under ``spark.checkpoint.dir``. That mark holds the partition and the position
in it, and it is read from the written rows: both branches below see one and
the same layout. (Two runs of a range shuffle sample their own bounds, so
counts of one run must never be used as offsets in another.) The rows of each
partition are counted (one small row per partition), the counts become start
offsets by a window over those few rows, and id = start + offset + position.
The result is ``start + 1, start + 2, ...`` in ``o`` order, the same numbers a
global ``row_number`` gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskpark.plans.materialize import materialize


PARTITION_BITS = 33  # monotonically_increasing_id: the partition above, the position in it below


def dense_ids(df: DataFrame, order_cols: list[str], start: Column, id_col: str,
              partitions: int | None = None) -> DataFrame:
    """Append ``id_col = start + global 1-based position by order_cols``.

    ``start`` is a scalar column (for example a scalar subquery of the
    current maximum id). ``order_cols`` must be unique together. The plan of
    ``df`` runs twice (range sampling, sort): pass a materialized one if it is
    expensive.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    marked = materialize(ranged.withColumn("_mark", F.monotonically_increasing_id()))
    marked = marked.withColumn("_pid", F.shiftright("_mark", PARTITION_BITS))
    position = F.col("_mark").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    counts = marked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (marked.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, (start + F.col("_off") + position + 1).cast("bigint"))
            .drop("_mark", "_pid", "_off"))
