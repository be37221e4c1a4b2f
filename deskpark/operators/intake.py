"""Ticket intake and receipts.

A batch of ``crear_ticket`` calls: check the type and urgency words, resolve
the service among the client's contracted ones, assign the default analyst
(NULL when there is none), number the new tickets after the current maximum
id and render the receipt sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.functions import vocab as V
from deskpark.operators.identity import default_assignee
from deskpark.operators.services import service_resolve
from deskpark.plans.ids import dense_ids
from deskpark.plans.materialize import materialize


def ticket_intake(intake_req: DataFrame, ticket: DataFrame, cliente_servicio: DataFrame, servicio: DataFrame,
                  external: DataFrame, analista: DataFrame, assignee_name: str = V.DEFAULT_ASSIGNEE_NAME
                  ) -> DataFrame:
    """One row per request: ``created`` with the new ticket, ``rejected`` (no
    such contracted service) or ``invalid`` (type or urgency outside the enums)."""
    valid = F.col("tipo").isin(*V.TICKET_TYPES) & F.col("nivel").isin(*V.TICKET_LEVELS)
    resolved = intake_req.join(service_resolve(intake_req, cliente_servicio, servicio), "req_id", "left")
    outcome = (F.when(~valid | F.col("tipo").isNull() | F.col("nivel").isNull(), "invalid")
               .when(F.col("id_cliente_servicio").isNull(), "rejected").otherwise("created"))
    r = materialize(resolved.withColumn("outcome", outcome))
    start = ticket.agg(F.coalesce(F.max("id_ticket"), F.lit(0))).scalar()
    new_ids = dense_ids(r.where(F.col("outcome") == "created").select("ts", "req_id"), ["ts", "req_id"],
                        start, "id_ticket")
    assignee = default_assignee(external, analista, assignee_name).select("id_analista").scalar()
    created = F.col("outcome") == "created"
    return r.join(new_ids.select("req_id", "id_ticket"), "req_id", "left").select(
        "req_id", "outcome", "id_ticket", "id_colaborador",
        F.when(created, F.col("id_cliente_servicio")).alias("id_cliente_servicio"),
        F.when(created, assignee).alias("id_analista"),
        "asunto", "tipo", "nivel",
        F.when(created, F.lit(V.STATUS_NEW)).alias("estado"),
        F.when(created, F.col("ts")).alias("created_at"), "thread_id")


def ticket_receipts(intake: DataFrame) -> DataFrame:
    """The sentence the tool returns per request."""
    ok0, ok1 = V.RECEIPT_OK.split("{id}")
    ok1a, ok1b = ok1.split("{ts}")
    when_text = X.ddmmyyyy_hms(F.coalesce(F.col("created_at"), F.current_timestamp().cast("timestamp_ntz")))
    ok = F.concat(F.lit(ok0), F.col("id_ticket").cast("string"), F.lit(ok1a), when_text, F.lit(ok1b))
    reply = F.when(F.col("outcome") == "created", ok).when(F.col("outcome") == "rejected", F.lit(V.RECEIPT_FAIL))
    return intake.select("req_id", "outcome", reply.alias("reply"))
