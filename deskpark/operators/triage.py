"""Rule-based triage of a conversation's type and urgency.

In the reference an LLM reads the conversation and picks ``tipo`` and
``nivel`` following rules written in its prompt. We offer a transparent
keyword form of those rules: the user turns are tokenized, joined to a small
keyword table (a literal, so its size is fixed and it is broadcast), hits are
counted per label. Its output will not match a model's judgement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskpark.operators.retrieval import tokens

# Our keyword reading of the prompt rules (not values of the reference).
TYPE_KEYWORDS = {
    "incidencia": ("error", "errores", "falla", "fallo", "roto", "rota", "caido", "caído", "bug", "broken",
                   "fails", "failure", "crash"),
    "solicitud": ("nuevo", "nueva", "acceso", "permiso", "información", "informacion", "solicito", "request",
                  "access", "new"),
}
LEVEL_KEYWORDS = {  # most severe first
    "crítico": ("caída", "caida", "caído", "caido", "pérdida", "perdida", "dinero", "pago", "pagos",
                "transacción", "transacciones", "fatal", "outage", "down"),
    "alto": ("bloqueante", "bloqueado", "bloquea", "impide", "blocked", "blocking"),
    "medio": ("lento", "lentitud", "demora", "funcionalidad", "slow"),
    "bajo": ("duda", "pregunta", "consulta", "estético", "estetico", "question"),
}
TYPE_DEFAULT, LEVEL_DEFAULT = "solicitud", "bajo"


def _rules(spark: SparkSession, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """The keyword table as an inline literal (constant size, planned as a local table)."""
    rows = [F.struct(F.lit(label).alias("label"), F.lit(rank).alias("rank"), F.lit(kw).alias("term"))
            for rank, (label, kws) in enumerate(table.items()) for kw in kws]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _hits(mensaje: DataFrame, table: dict[str, tuple[str, ...]]) -> DataFrame:
    words = (mensaje.where(F.col("role") == "user")
             .select("id_ticket", F.explode(tokens("content")).alias("term")))
    rules = F.broadcast(_rules(mensaje.sparkSession, table))
    return (words.join(rules, "term").groupBy("id_ticket", "label", "rank")
            .agg(F.count(F.lit(1)).alias("hits")))


def triage_type(mensaje: DataFrame) -> DataFrame:
    """Label with most keyword hits; ties go to ``incidencia``; none: ``solicitud``."""
    hits = _hits(mensaje, TYPE_KEYWORDS)
    best = hits.groupBy("id_ticket").agg(
        F.max(F.struct("hits", (-F.col("rank")).alias("r"), "label")).alias("m"))
    return (mensaje.select("id_ticket").distinct().join(best, "id_ticket", "left")
            .select("id_ticket", F.coalesce(F.col("m.label"), F.lit(TYPE_DEFAULT)).alias("tipo"),
                    F.coalesce(F.col("m.hits"), F.lit(0)).alias("hits")))


def triage_urgency(mensaje: DataFrame) -> DataFrame:
    """Most severe urgency with a keyword hit; none: ``bajo``."""
    hits = _hits(mensaje, LEVEL_KEYWORDS)
    best = hits.groupBy("id_ticket").agg(F.min(F.struct("rank", "label", "hits")).alias("m"))
    return (mensaje.select("id_ticket").distinct().join(best, "id_ticket", "left")
            .select("id_ticket", F.coalesce(F.col("m.label"), F.lit(LEVEL_DEFAULT)).alias("nivel"),
                    F.coalesce(F.col("m.hits"), F.lit(0)).alias("hits")))
