"""Write a derived DataFrame once when several branches of a plan read it.

Spark re-runs a shared sub-plan for every branch whose column pruning
differs, and AQE cannot reuse such exchanges. Where an expensive derived
table feeds several branches (command validation rounds, id numbering, reply
parts), we cut the lineage with a reliable checkpoint under the session's
``spark.checkpoint.dir`` (a shared folder on a cluster). The sub-plan runs
once, and a lost executor re-reads the files instead of recomputing it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from deskpark.session import checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        checkpoint_dir(spark)
    return df.checkpoint(eager=True)
