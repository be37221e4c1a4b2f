"""Escalation of tickets to a more senior analyst.

**Candidate pick without a theta join.** The reference picks a random
analyst of strictly greater seniority (``ORDER BY random() LIMIT 1``). Put
the analysts in (nivel desc, id) order and number them 0..n-1; the analysts
senior to level L are then exactly the first ``above(L)`` positions. A
command picks position ``hash(seed, cmd_id) mod above(L)``: a deterministic,
uniform choice found by an **equi-join on the position**. No pair of
analysts is ever formed.

**Sequential commands in parallel.** An accepted escalation moves the
ticket to a strictly more senior analyst, and analysts at level >= 3 may not
escalate, so a ticket moves at most once per distinct level below 3 in a
batch (twice with levels 1, 2, 3). Each round finds, per ticket, the first
command (by ts, cmd_id) after the previous move whose issuer is the current
assignee and who has a candidate. Then every command is judged against the
assignee at its time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.functions import vocab as V
from deskpark.operators.inbox import analyst_of_person
from deskpark.plans.ids import dense_ids
from deskpark.plans.materialize import materialize

SEED = 7


def level_table(analista: DataFrame) -> DataFrame:
    """Per seniority level: analysts at it and analysts strictly above it.

    One row per distinct level, so the running sum runs over a handful of rows.
    """
    lv = analista.groupBy("nivel").agg(F.count(F.lit(1)).alias("n_level"))
    above = F.sum("n_level").over(Window.orderBy(F.col("nivel").desc())
                                  .rowsBetween(Window.unboundedPreceding, -1))
    return lv.select("nivel", "n_level", F.coalesce(above, F.lit(0)).alias("n_above"))


def analyst_positions(analista: DataFrame) -> DataFrame:
    """Analysts with a level, numbered 0..n-1 in (nivel desc, id_analista) order by a distributed sort.

    Nearly all analysts may be of one level, so no window is laid over a level.
    """
    known = analista.where(F.col("nivel").isNotNull()).select("id_analista", (-F.col("nivel")).alias("_down"))
    return dense_ids(known, ["_down", "id_analista"], F.lit(-1), "pos").select("id_analista", "pos")


def with_candidates(issued: DataFrame, analista: DataFrame) -> DataFrame:
    """Add ``n_candidates`` and ``cand`` for rows with ``cmd_id`` and ``issuer_level``."""
    lv = level_table(analista).select(F.col("nivel").alias("issuer_level"), F.col("n_above").alias("n_candidates"))
    pos = analyst_positions(analista).select(F.col("id_analista").alias("cand"), F.col("pos").alias("_pick"))
    pick = F.when(F.col("n_candidates") > 0,
                  F.pmod(X.md5_bigint(F.lit(SEED), F.col("cmd_id")), F.col("n_candidates")))
    j = issued.join(lv, "issuer_level", "left").withColumn("_pick", pick)
    return j.join(pos, "_pick", "left").drop("_pick").withColumn(
        "n_candidates", F.coalesce(F.col("n_candidates"), F.lit(0)))


def escalation_candidates(cmds: DataFrame, analista: DataFrame) -> DataFrame:
    an = analyst_of_person(analista)
    issued = cmds.join(an, "id_persona").select("cmd_id", F.col("id_analista").alias("issuer"),
                                               F.col("analyst_level").alias("issuer_level"))
    return with_candidates(issued, analista).select(
        "cmd_id", "issuer", "issuer_level", "n_candidates", F.col("cand").alias("id_candidate"))


def move_rounds(analista: DataFrame) -> int:
    """Most moves a ticket can make in one batch: distinct levels allowed to escalate."""
    return max(1, analista.where(F.col("nivel") < V.ESCALATION_MAX_LEVEL).select("nivel").distinct().count())


def escalation_validate(cmds: DataFrame, analista: DataFrame, ticket: DataFrame,
                        rounds: int | None = None) -> DataFrame:
    """Outcome code per command (C4): 422 short reason, 403 not an analyst,
    403 level >= 3, 404 no ticket, 403 not the assignee at that time,
    409 no senior analyst, else 200 with the new assignee.

    ``rounds`` defaults to ``move_rounds(analista)`` (one small query on the
    analyst table), which makes the fold exact for any level values."""
    if rounds is None:
        rounds = move_rounds(analista)
    an = analyst_of_person(analista)
    t = ticket.select("id_ticket", F.col("id_analista").alias("a0"), F.lit(True).alias("_t"))
    j = cmds.join(an, "id_persona", "left").join(t, "id_ticket", "left") \
        .withColumnRenamed("id_analista", "issuer").withColumnRenamed("analyst_level", "issuer_level")
    static = (F.when(F.col("motivo").isNull() | (F.length("motivo") < V.ESCALATION_REASON_MIN_CHARS), 422)
              .when(F.col("issuer").isNull(), 403)
              .when(F.col("issuer_level") >= V.ESCALATION_MAX_LEVEL, 403)
              .when(F.col("_t").isNull(), 404))
    # Read by every round below: written once (commands x analysts x tickets, with the candidate).
    j = materialize(with_candidates(j.withColumn("static_code", static), analista))
    ok = j.where(F.col("static_code").isNull()).select("cmd_id", "ts", "id_ticket", "issuer", "a0", "cand")

    # Rounds of moves: (id_ticket, after_ts, after_id, assignee).
    state = ok.groupBy("id_ticket").agg(F.min("a0").alias("assignee")) \
        .select("id_ticket", F.lit(None).cast("timestamp_ntz").alias("after_ts"),
                F.lit(None).cast("bigint").alias("after_id"), "assignee")
    moves = []
    for _ in range(rounds):
        after = (F.col("after_ts").isNull() | (F.col("ts") > F.col("after_ts"))
                 | ((F.col("ts") == F.col("after_ts")) & (F.col("cmd_id") > F.col("after_id"))))
        eligible = ok.join(state, "id_ticket").where((F.col("issuer") == F.col("assignee"))
                                                      & F.col("cand").isNotNull() & after)
        first = eligible.groupBy("id_ticket").agg(F.min(F.struct("ts", "cmd_id", "cand")).alias("m"))
        state = first.select("id_ticket", F.col("m.ts").alias("after_ts"), F.col("m.cmd_id").alias("after_id"),
                             F.col("m.cand").alias("assignee"))
        moves.append(state)
    all_moves = moves[0]
    for m in moves[1:]:
        all_moves = all_moves.unionByName(m)
    # Assignee at the time of each command: after the last earlier move, else the original.
    before = ((F.col("after_ts") < F.col("ts"))
              | ((F.col("after_ts") == F.col("ts")) & (F.col("after_id") < F.col("cmd_id"))))
    last_move = (ok.select("cmd_id", "ts", "id_ticket").join(all_moves, "id_ticket").where(before)
                 .groupBy("cmd_id").agg(F.max(F.struct("after_ts", "after_id", "assignee"))["assignee"]
                                        .alias("moved_to")))
    judged = ok.join(last_move, "cmd_id", "left").withColumn(
        "assignee_then", F.when(F.col("moved_to").isNotNull(), F.col("moved_to")).otherwise(F.col("a0")))
    dyn = (F.when(~F.col("issuer").eqNullSafe(F.col("assignee_then")), 403)
           .when(F.col("cand").isNull(), 409).otherwise(200))
    dyn_df = judged.select("cmd_id", dyn.alias("dyn_code"))
    out = j.join(dyn_df, "cmd_id", "left")
    code = F.coalesce(F.col("static_code"), F.col("dyn_code"))
    return out.select("cmd_id", "ts", "id_ticket", code.alias("code"),
                      F.col("issuer").alias("id_analista_solicitante"),
                      F.when(code == 200, F.col("cand")).alias("id_analista_derivado"), "motivo")


def escalation_apply(ticket: DataFrame, validated: DataFrame) -> DataFrame:
    """New ticket snapshot: the last accepted move sets the assignee; status
    and ``updated_at`` stay as they were (C5, T9)."""
    acc = validated.where(F.col("code") == 200)
    last = acc.groupBy("id_ticket").agg(
        F.max(F.struct("ts", "cmd_id", "id_analista_derivado"))["id_analista_derivado"].alias("n_analista"))
    t = ticket.join(last, "id_ticket", "left")
    return t.select(*[F.coalesce(F.col("n_analista"), F.col(c)).alias(c) if c == "id_analista" else F.col(c)
                      for c in ticket.columns])


def escalation_log(escalado: DataFrame, validated: DataFrame) -> DataFrame:
    """Rows appended to the escalation log, ids continuing after the current maximum."""
    acc = validated.where(F.col("code") == 200).select(
        "ts", "cmd_id", "id_ticket", "id_analista_solicitante", "id_analista_derivado", "motivo")
    start = escalado.agg(F.coalesce(F.max("id_escalado"), F.lit(0))).scalar()
    return dense_ids(acc, ["ts", "cmd_id"], start, "id_escalado").select(
        "id_escalado", "id_ticket", "id_analista_solicitante", "id_analista_derivado", "motivo", "cmd_id")
