"""Production sources: the support-desk tables with their fixed schemas.

``ParquetTables(spark, root)`` reads ``<root>/<table>/`` with the explicit
schema of ``schemas``; no inference, a missing column fails at once.
``JdbcTables`` reads the same tables from the operational database in
parallel, split on a numeric key, for a one-off export. Either object
exposes the same attributes as the test fixture (``ticket``, ``analista``,
...), so every operator runs unchanged on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deskpark.sources import schemas as S

TABLES = {
    "ticket": S.TICKET, "cliente": S.CLIENTE, "colaborador": S.COLABORADOR, "analista": S.ANALISTA,
    "external": S.EXTERNAL, "servicio": S.SERVICIO, "cliente_servicio": S.CLIENTE_SERVICIO,
    "escalado": S.ESCALADO, "mensaje": S.MENSAJE, "kb_document": S.KB_DOCUMENT,
}


class ParquetTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)


class JdbcTables:
    """Partitioned JDBC reads: ``partition_column`` between bounds in ``num_partitions`` slices."""

    def __init__(self, spark: SparkSession, url: str, properties: dict, split: dict[str, tuple[str, int, int]],
                 num_partitions: int = 64):
        self.spark, self.url, self.properties = spark, url, properties
        self.split, self.num_partitions = split, num_partitions

    def read(self, name: str) -> DataFrame:
        if name in self.split:
            col, lo, hi = self.split[name]
            df = self.spark.read.jdbc(self.url, name, column=col, lowerBound=lo, upperBound=hi,
                                      numPartitions=self.num_partitions, properties=self.properties)
        else:
            df = self.spark.read.jdbc(self.url, name, properties=self.properties)
        return S.conform(df, TABLES[name])

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)
