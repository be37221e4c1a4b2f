"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskpark.session import checkpoint_dir

#: A word of every contract here: a run without ASCII white space.
ASCII_SPACE = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def learnable(doc_id: Column) -> Column:
    """True for rows that a model may learn from: crc32(doc_id as text) mod 3 is not 1; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def held_out(doc_id: Column) -> Column:
    """True for rows kept back from learning; a null id is false (and is not learned from either)."""
    return F.coalesce(~learnable(doc_id), F.lit(False))


def words_of(text: Column) -> Column:
    """Array of the runs without ASCII white space; empty for a null text."""
    plain = F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, " " * len(ASCII_SPACE))
    return F.array_remove(F.split(F.trim(plain), " ", -1), "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row, however often body uses it.

    The optimizer puts an alias back into each place that uses it; a lambda's variable stays bound.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), 0)


def sample_rows(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """At most ``limit`` rows, those of the smallest hashed ids: the same ones at any partitioning.

    The ids are chosen first, from the id column alone, and at most ``limit`` of them are broadcast.
    """
    ids = df.select("doc_id").where("doc_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return df.select("doc_id", *columns).join(F.broadcast(ids), "doc_id", "left_semi")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of the cluster; one without a scheme lies in Hadoop's default file system."""
    import uuid

    base = re.sub(r"/+$", "", checkpoint_dir(spark))
    if "://" not in base and not base.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        base = re.sub(r"/+$", "", default.replace("file:///", "file://")) + base if "://" in default else f"file://{base}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


class Generations(dict):
    """Values of words in two generations: when the young one is full, it becomes the old one.

    A word that is met again is taken over from the old generation, so that common words stay and the
    many that occur once go; both hold ``size`` words and those of one more call at most.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def unknown(self, words: set[str]) -> list[str]:
        """The words that are in neither generation; all others are in the young one afterwards."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        missing = words.difference(self)
        kept = missing.intersection(self.old)
        self.update((w, self.old[w]) for w in kept)
        return list(missing.difference(kept))


def few_threads() -> None:
    """Sets the tokenizers library, before its first use, to as many threads as an executor's task has cores to hand."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", "2")


#: Rows of a batch sent to Python, where the session leaves it at Spark's 10,000: texts are long.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once for a context; they need no copy of their own.

    Also sets the session's rows of a Python batch to ``BATCH_ROWS``, unless it has a value of its own.
    """
    import os
    import tempfile
    import zipfile

    import deskpark

    context, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if getattr(context, "_deskpark_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(deskpark.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="deskpark-code-"), "deskpark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._deskpark_shipped = True
