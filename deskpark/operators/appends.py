"""What a batch of intake calls or escalations adds to the tables, in the tables' own schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.functions import vocab as V
from deskpark.sources import schemas as S
from deskpark.sources.appends import AppendTables

#: The tables that intake and escalation add rows to.
TABLES = {"ticket": S.TICKET, "conversacion": S.CONVERSACION, "escalado": S.ESCALADO}


def new_tickets(intake: DataFrame) -> DataFrame:
    """Rows of the ticket table for the created tickets; what a new ticket does not have yet is NULL (S3)."""
    created = intake.where(F.col("outcome") == "created")
    given = set(intake.columns)
    return created.select(*[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.TICKET.fields])


def new_conversations(intake: DataFrame, thread_turns: DataFrame) -> DataFrame:
    """Rows of the conversation table: the kept turns of each created ticket's thread, renamed, in order.

    A created ticket whose thread has no kept turn gets an empty conversation.
    """
    created = intake.where(F.col("outcome") == "created").select("id_ticket", "thread_id")
    role = F.element_at(X.literal_map(V.ROLE_RENAME), F.col("role"))
    kept = thread_turns.where(F.col("role").isin(*V.ROLE_RENAME)).join(created.select("thread_id").distinct(), "thread_id", "left_semi")
    turns = F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), "content")))
    said = kept.groupBy("thread_id").agg(
        F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("contenido"))
    empty = F.array().cast(S.CONVERSACION["contenido"].dataType)
    return created.join(said, "thread_id", "left").select("id_ticket", F.coalesce("contenido", empty).alias("contenido"))


def append_intake(tables: AppendTables, batch: str, intake: DataFrame, thread_turns: DataFrame) -> None:
    """Tickets and their conversations of one batch become visible together; the batch may be run again."""
    tables.append(batch, {"ticket": new_tickets(intake), "conversacion": new_conversations(intake, thread_turns)})


def append_escalations(tables: AppendTables, batch: str, log: DataFrame) -> None:
    """The log rows of one batch of accepted escalations (``escalation.escalation_log``)."""
    tables.append(batch, {"escalado": log.select(*S.ESCALADO.names)})
