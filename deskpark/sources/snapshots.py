"""Versioned table snapshots (the sink for updates: parquet has no MERGE).

``<root>/v=000000000007/`` holds version 7 of the table; a version that a
stream wrote also names what it came from, ``v=000000000007.s=<stream>.e=5``,
so that version and origin become visible in one step. Writers only add new
version directories; readers take the highest complete one (with a
``_SUCCESS`` marker). Directory listing goes through Hadoop's FileSystem, so
the root may be any shared file system the cluster names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"v=(\d+)(?:\.s=([^.]+)\.e=(\d+))?$")


class SnapshotStore:
    """With ``schema`` a version is read by it: a missing column reads as null, never as another type."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _complete(self) -> dict[int, tuple[str, tuple[str, int] | None]]:
        """Version -> its directory's name and, for a stream's version, (stream, epoch)."""
        fs, jvm = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        if not fs.exists(root):
            return {}
        out = {}
        for st in fs.listStatus(root):
            name = st.getPath().getName()
            m = _NAME.match(name)
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out[int(m[1])] = (name, (m[2], int(m[3])) if m[2] else None)
        return out

    def path(self, version: int, origin: tuple[str, int] | None = None) -> str:
        tag = f".s={origin[0]}.e={origin[1]}" if origin else ""
        return f"{self.root}/v={version:012d}{tag}"

    def versions(self) -> list[int]:
        return sorted(self._complete())

    def has(self, version: int) -> bool:
        return version in self._complete()

    def origins(self) -> set[tuple[str, int]]:
        """The (stream, epoch) pairs that have become versions."""
        return {origin for _, origin in self._complete().values() if origin}

    def write(self, df: DataFrame, version: int | None = None, origin: tuple[str, int] | None = None) -> int:
        """Write a version, the latest plus one by default. A complete version is never replaced; a directory
        left without ``_SUCCESS`` by a failed attempt is (readers ignore it)."""
        known = self._complete()
        version = max(known, default=-1) + 1 if version is None else version
        if version in known:
            raise FileExistsError(self.path(version))
        df.write.mode("overwrite").parquet(self.path(version, origin))
        return version

    def read(self, version: int) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(f"{self.root}/{self._complete()[version][0]}")

    def read_latest(self) -> DataFrame:
        vs = self.versions()
        if not vs:
            raise FileNotFoundError(f"no snapshot under {self.root}")
        return self.read(vs[-1])


class BucketStore(SnapshotStore):
    """A table of which a version holds only the buckets that it changed.

    A row's bucket is a hash of its key; the table is, for each bucket, its rows in the latest version
    that has the bucket. A version that touches few keys reads and writes few buckets. ``compact`` writes
    a version of all buckets, before which earlier ones are not looked at.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = 256):
        super().__init__(spark, root, schema)
        self.key, self.buckets = key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets that rows of ``df`` fall into (at most ``buckets`` numbers)."""
        return sorted(r[0] for r in df.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect())

    def write(self, df: DataFrame, version: int | None = None, origin: tuple[str, int] | None = None) -> int:
        """Writes the rows of the buckets that ``df`` holds, all rows of each."""
        known = self._complete()
        version = max(known, default=-1) + 1 if version is None else version
        if version in known:
            raise FileExistsError(self.path(version))
        placed = df.select(*self.schema.names).withColumn("_bucket", self.bucket())
        placed.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self.path(version, origin))
        return version

    def locations(self) -> dict[int, str]:
        """Bucket -> folder of its latest rows."""
        fs, jvm = self._fs()
        out: dict[int, str] = {}
        for _, (name, _) in sorted(self._complete().items(), reverse=True):
            for st in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")):
                part = st.getPath().getName()
                if part.startswith("_bucket="):
                    out.setdefault(int(part[8:]), f"{self.root}/{name}/{part}")
            if len(out) == self.buckets:
                break
        return out

    def read_latest(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or those buckets of it."""
        held = self.locations()
        paths = [held[b] for b in (sorted(held) if buckets is None else buckets) if b in held]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def compact(self) -> int:
        return self.write(self.read_latest())
