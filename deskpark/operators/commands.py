"""Status and urgency commands of analysts, validated and folded.

The reference changes one ticket per request and commits at once. A batch
of commands is applied here in two set-based steps:

1. **validate** every command on its own. Status commands never change the
   assignee, so the checks of one command do not depend on earlier ones.
2. **fold** the accepted commands per ticket, ordered by ``(ts, cmd_id)``,
   with aggregates that are partial before the shuffle (no per-ticket loop):
   last status wins, ``closed_at`` is the last close, the diagnosis the
   last non-empty description given on a close, the urgency the last valid
   one. The fold result is left-joined to the snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.functions import vocab as V
from deskpark.operators.inbox import analyst_of_person


def normalize_status(cmds: DataFrame) -> DataFrame:
    return cmds.select("cmd_id", "status", X.status_from_ui("status").alias("db_status"))


def normalize_level(cmds: DataFrame) -> DataFrame:
    return cmds.select("cmd_id", "level", X.level_from_ui("level").alias("db_level"))


def status_validate(cmds: DataFrame, analista: DataFrame, ticket: DataFrame) -> DataFrame:
    """Outcome codes in the reference's order.

    ``status_code``: 403 not an analyst, 404 no ticket, 403 not the assignee
    (an unassigned ticket included), 400 unknown status, else 200.
    ``level_code``: NULL unless the status was applied and a level was sent;
    then 400 unknown level or 200. A bad level does not undo the status.
    """
    an = analyst_of_person(analista).select("id_persona", "id_analista")
    t = ticket.select("id_ticket", F.col("id_analista").alias("assignee"), F.lit(True).alias("_t"))
    j = X.guard_ids(cmds, "id_persona").join(an, "id_persona", "left").join(t, "id_ticket", "left")
    db_status, db_level = X.status_from_ui("status"), X.level_from_ui("level")
    status_code = (F.when(F.col("id_analista").isNull(), 403).when(F.col("_t").isNull(), 404)
                   .when(~F.col("assignee").eqNullSafe(F.col("id_analista")), 403)
                   .when(db_status.isNull(), 400).otherwise(200))
    level_given = F.col("level").isNotNull() & (F.col("level") != "")
    level_code = (F.when(status_code != 200, F.lit(None)).when(~level_given, F.lit(None))
                  .when(db_level.isNull(), 400).otherwise(200))
    return j.select("cmd_id", "ts", "id_ticket", "id_analista", status_code.alias("status_code"),
                    level_code.alias("level_code"), db_status.alias("db_status"), db_level.alias("db_level"),
                    "description")


def _last(cond, value):
    """Value of the last row by (ts, cmd_id) among rows where ``cond`` holds."""
    return F.max(F.when(cond, F.struct("ts", "cmd_id", value.alias("v"))))["v"]


def status_fold(validated: DataFrame) -> DataFrame:
    """Per ticket: the changes a sequence of accepted commands leaves behind."""
    acc = validated.where(F.col("status_code") == 200)
    closing = F.col("db_status") == V.STATUS_CLOSED
    with_text = closing & F.col("description").isNotNull() & (F.col("description") != "")
    return acc.groupBy("id_ticket").agg(
        _last(F.lit(True), F.col("db_status")).alias("n_estado"),
        F.max("ts").alias("n_updated_at"),
        F.max(F.when(closing, F.col("ts"))).alias("n_closed_at"),
        _last(with_text, F.substring("description", 1, V.DIAGNOSIS_MAX_CHARS)).alias("n_diagnostico"),
        _last(F.col("level_code") == 200, F.col("db_level")).alias("n_nivel"))


def status_apply(ticket: DataFrame, validated: DataFrame) -> DataFrame:
    """New ticket snapshot after the commands."""
    fold = status_fold(validated)
    t = ticket.join(fold, "id_ticket", "left")
    changed = F.col("n_estado").isNotNull()
    cols = []
    for c in ticket.columns:
        if c == "estado":
            cols.append(F.when(changed, F.col("n_estado")).otherwise(F.col("estado")).alias(c))
        elif c == "updated_at":
            cols.append(F.when(changed, F.col("n_updated_at")).otherwise(F.col("updated_at")).alias(c))
        elif c in ("closed_at", "diagnostico", "nivel"):
            cols.append(F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return t.select(*cols)
