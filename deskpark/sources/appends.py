"""Appends to several tables at once, safe to repeat.

The reference inserts a ticket, its conversation or a log row in one transaction. Here a batch of rows is
written in each table's own schema under the partition ``batch=<id>``, with dynamic partition overwrite, so
that a batch that is run again replaces its rows and adds none; a commit row, written last, makes the batch
visible in all tables together. Rows of a batch without a commit row (a failed run) are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"
COMMITS = "commits"


class AppendTables:
    """Tables under ``root``, a folder that all executors share; ``schemas`` names them and their columns."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        for name in [*schemas, COMMITS]:
            self._write(name, spark.createDataFrame([], self._schema(name)), "append")

    def _schema(self, name: str) -> T.StructType:
        own = self.schemas[name].fields if name != COMMITS else []
        return T.StructType([*own, T.StructField(BATCH, T.StringType(), True)])

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        if name == COMMITS:
            rows = rows.withColumn("committed", F.lit(True))
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(f"{self.root}/{name}")

    def append(self, batch: str, rows: dict[str, DataFrame]) -> None:
        """Writes the rows of one batch and commits it; the same batch again has the same effect as once.

        A batch of no rows is committed as well. Rows must have their table's columns (others are an error).
        """
        for name, df in rows.items():
            schema = self.schemas[name]
            if set(df.columns) != set(schema.names):
                raise ValueError(f"{name}: columns {df.columns}, expected {schema.names}")
            typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
            self._write(name, typed.withColumn(BATCH, F.lit(batch)), "overwrite")
        self._write(COMMITS, self.spark.range(1).select(F.lit(batch).alias(BATCH)), "overwrite")

    def committed(self) -> DataFrame:
        schema = T.StructType([T.StructField("committed", T.BooleanType(), True), T.StructField(BATCH, T.StringType(), True)])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{COMMITS}").select(BATCH).distinct()

    def read(self, name: str, but: str | None = None) -> DataFrame:
        """Rows of all committed batches in the table's schema; without those of batch ``but``, for a run that repeats it."""
        rows = self.spark.read.schema(self._schema(name)).parquet(f"{self.root}/{name}")
        if but is not None:
            rows = rows.where(F.col(BATCH) != but)
        return rows.join(self.committed(), BATCH, "left_semi").select(*self.schemas[name].names)
