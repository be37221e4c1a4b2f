"""ST1: conversations kept up to date from a stream of chat turns.

The reference keeps each thread's messages in process memory (lost on
restart). Here the turns arrive as a stream; a streaming aggregation keyed
by ticket keeps the turn list in the checkpointed state store, with the same
aggregate expressions as the batch job, so stream and batch agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from deskpark.operators.transcripts import as_json, conversation_aggs
from deskpark.sources import schemas as S


def read_turns(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(S.MENSAJE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def conversations_stream(turns: DataFrame) -> DataFrame:
    """Streaming ``id_ticket, n_messages, contenido`` (JSON text); complete or update mode."""
    return as_json(turns.groupBy("id_ticket").agg(*conversation_aggs()))


def start(spark: SparkSession, source: str, checkpoint: str, sink, trigger_once: bool = True,
          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Run the stream; ``sink(batch_df, epoch_id)`` receives every updated conversation."""
    q = (conversations_stream(read_turns(spark, source, max_files_per_trigger))
         .writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(sink))
    q = q.trigger(availableNow=True) if trigger_once else q
    return q.start()
