"""ST2: status commands applied as they arrive, one snapshot version per micro-batch.

Each micro-batch is validated against the latest rows of the ticket buckets
that its commands name and folded with the batch operators
(``commands.status_validate`` / ``status_apply``); those buckets are written
as a new version, numbered latest + 1, whose directory names the stream and
epoch it came from: one command reads and rewrites one bucket. A replayed epoch (after a failure)
finds exactly its own pair and is skipped; another stream, or the same
commands folder read with a new checkpoint, has another stream id, so its
batches are never taken for old ones. Streams share a store one at a time.

Every command is applied on arrival, however late its time. For sources that
deliver a command more than once, ``applied_log`` names a folder in which the
ids of applied commands are kept: a batch drops ids that it or an earlier
epoch holds already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deskpark.operators.commands import status_apply, status_validate
from deskpark.plans.materialize import materialize
from deskpark.sources import schemas as S
from deskpark.sources.snapshots import BucketStore, SnapshotStore


def read_commands(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(S.STATUS_CMD)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def first_of_each(batch: DataFrame, log: SnapshotStore, origin: tuple[str, int]) -> DataFrame:
    """Commands whose id no other epoch has applied, one row of each id (the earliest by time)."""
    once = batch.groupBy("cmd_id").agg(F.min(F.struct("ts", *[c for c in batch.columns if c not in ("cmd_id", "ts")])).alias("c"))
    once = once.select("cmd_id", "c.*").select(batch.columns)
    for version, (_, made_by) in log._complete().items():
        if made_by != origin:  # a replayed epoch must see its own commands as new
            once = once.join(log.read(version), "cmd_id", "left_anti")
    return once


def apply_batch(store: BucketStore, analista: DataFrame, stream: str, log: SnapshotStore | None = None):
    """The foreachBatch function of a stream; ``stream`` identifies its checkpoint."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        origin = (stream, epoch_id)
        if origin in store.origins():
            return
        if log is not None:
            batch = materialize(first_of_each(batch, log, origin))
            if origin not in log.origins():
                log.write(batch.select("cmd_id"), origin=origin)
        current = store.read_latest(store.touched(batch))
        store.write(status_apply(current, status_validate(batch, analista, current)), origin=origin)

    return run


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of a checkpoint, made when it is first used and kept in it: a cleared checkpoint is a new stream."""
    import uuid

    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(checkpoint, "stream-id")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "id string").coalesce(1).write.text(str(path))
    return spark.read.text(str(path)).first()[0]


def start(spark: SparkSession, commands_path: str, store: BucketStore, analista: DataFrame,
          checkpoint: str, max_files_per_trigger: int | None = None,
          applied_log: str | None = None) -> StreamingQuery:
    log = SnapshotStore(spark, applied_log) if applied_log else None
    run = apply_batch(store, analista, stream_id(spark, checkpoint), log)
    return (read_commands(spark, commands_path, max_files_per_trigger)
            .writeStream.option("checkpointLocation", f"{checkpoint}/query")
            .foreachBatch(run).trigger(availableNow=True).start())
