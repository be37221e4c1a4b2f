"""Stored conversations of tickets.

The agent memory keeps every turn (system and tool turns included); the
stored conversation keeps the human and AI turns in order, renamed to
``user`` / ``agent``. A ticket whose memory has only system turns still gets a
conversation: the empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.functions import vocab as V


def _message(x: Column) -> Column:
    role = F.element_at(X.literal_map(V.ROLE_RENAME), x["role"])
    return F.struct(role.alias("role"), x["content"].alias("content"))


def conversation_aggs() -> list[Column]:
    """Aggregates that turn the turns of one ticket into its conversation.

    The same expressions serve the batch job and the streaming job (ST1).
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    kept = F.filter(turns, lambda x: x["role"].isin(*V.ROLE_RENAME))
    return [F.transform(kept, _message).alias("contenido")]


def conversations(mensaje: DataFrame, key: str = "id_ticket") -> DataFrame:
    """``key, contenido array<struct<role, content>>`` per ticket (or thread)."""
    return mensaje.groupBy(key).agg(*conversation_aggs())


def as_json(conv: DataFrame, key: str = "id_ticket") -> DataFrame:
    """Conversation as the JSON text the database column holds."""
    return conv.select(key, F.size("contenido").alias("n_messages"),
                       F.to_json("contenido").alias("contenido"))


def transcripts(mensaje: DataFrame, key: str = "id_ticket") -> DataFrame:
    return as_json(conversations(mensaje, key), key)


TURNS_PER_PART = 1000


def transcript_parts(mensaje: DataFrame, key: str = "id_ticket") -> DataFrame:
    """The stored conversation as bounded JSON fragments (A3 for very long threads).

    Rows ``key, part, n_messages, fragment``: part p holds the kept messages
    with ``turn div 1000 = p`` as JSON objects joined by commas. The JSON
    text of the conversation is ``'[' + ','.join(fragments by part) + ']'``, so
    no group holds a whole thread. A thread without a kept message has one
    row, part 0 with an empty fragment.
    """
    kept = mensaje.where(F.col("role").isin(*V.ROLE_RENAME))
    msg = F.to_json(F.struct(F.element_at(X.literal_map(V.ROLE_RENAME), F.col("role")).alias("role"),
                             F.col("content").alias("content")))
    part = F.floor(F.col("turn") / TURNS_PER_PART).cast("bigint")
    items = F.array_sort(F.collect_list(F.struct("turn", msg.alias("m"))))
    parts = kept.groupBy(key, part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.array_join(F.transform(items, lambda x: x["m"]), ",").alias("fragment"))
    has_kept = F.max(F.coalesce(F.col("role").isin(*V.ROLE_RENAME), F.lit(False)))
    silent = mensaje.groupBy(key).agg(has_kept.alias("_kept")).where(~F.col("_kept")).select(
        key, F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("n_messages"),
        F.lit("").alias("fragment"))
    return parts.unionByName(silent)


def intake_conversations(intake: DataFrame, thread_turns: DataFrame) -> DataFrame:
    """Conversation stored with every created ticket.

    ``thread_turns`` holds the chat memory keyed by ``thread_id``. A created
    ticket whose thread has no memory still gets a conversation: ``[]``.
    """
    created = intake.where(F.col("outcome") == "created").select("id_ticket", "thread_id")
    conv = transcripts(thread_turns, "thread_id")
    return created.join(conv, "thread_id", "left").select(
        "id_ticket", "thread_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
        F.coalesce("contenido", F.lit("[]")).alias("contenido"))
