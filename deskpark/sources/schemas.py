"""Explicit schemas of the domain tables (no inference, fail fast).

Ids are BIGINT: the generated test data has integer keys where a production
database would hold UUID strings. Two different ``nivel`` columns exist: an
integer seniority on ``analista`` and a string urgency on ``ticket``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

L, S, I, TS = T.LongType(), T.StringType(), T.IntegerType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


TICKET = _struct(("id_ticket", L), ("id_colaborador", L), ("id_cliente_servicio", L), ("id_analista", L),
                 ("asunto", S), ("tipo", S), ("nivel", S), ("estado", S), ("diagnostico", S),
                 ("created_at", TS), ("updated_at", TS), ("closed_at", TS))
CLIENTE = _struct(("id_cliente", L), ("nombre", S))
COLABORADOR = _struct(("id_colaborador", L), ("id_persona", L), ("id_cliente", L))
ANALISTA = _struct(("id_analista", L), ("id_persona", L), ("nivel", I))
EXTERNAL = _struct(("id_persona", L), ("provider", S), ("id_provider", S), ("correo", S), ("nombre", S), ("hd", S))
SERVICIO = _struct(("id_servicio", L), ("nombre", S))
CLIENTE_SERVICIO = _struct(("id_cliente_servicio", L), ("id_cliente", L), ("id_servicio", L))
ESCALADO = _struct(("id_escalado", L), ("id_ticket", L), ("id_analista_solicitante", L),
                   ("id_analista_derivado", L), ("motivo", S))
# Raw chat messages as the agent memory holds them: role is user/assistant/system.
MENSAJE = _struct(("id_ticket", L), ("turn", L), ("role", S), ("content", S))
MESSAGE = T.StructType([T.StructField("role", S, True), T.StructField("content", S, True)])
CONVERSACION = _struct(("id_ticket", L), ("contenido", T.ArrayType(MESSAGE)))
KB_DOCUMENT = _struct(("doc_id", L), ("text", S))

# Request and command tables (one row per call the reference would serve).
INBOX_REQ = _struct(("req_id", L), ("id_persona", L), ("status", S), ("page_limit", I), ("page_offset", I))
LOOKUP_REQ = _struct(("req_id", L), ("id_colaborador", L), ("id_ticket", L))
SEARCH_REQ = _struct(("id_colaborador", L), ("q", S))
INTAKE_REQ = _struct(("req_id", L), ("id_colaborador", L), ("id_cliente", L), ("nombre_servicio", S),
                     ("tipo", S), ("nivel", S), ("asunto", S), ("ts", TS), ("thread_id", L))
LOGIN = _struct(("login_id", L), ("ts", TS), ("id_provider", S), ("correo", S), ("nombre", S), ("hd", S))
LOGIN_FEED = _struct(*[(f.name, f.dataType) for f in LOGIN.fields], ("iss", S))
STATUS_CMD = _struct(("cmd_id", L), ("ts", TS), ("id_ticket", L), ("id_persona", L), ("status", S),
                     ("level", S), ("description", S))
ESCALATION_CMD = _struct(("cmd_id", L), ("ts", TS), ("id_ticket", L), ("id_persona", L), ("motivo", S))
KB_QUESTION = _struct(("conv_id", L), ("turn", L), ("q", S))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns of ``schema``; a missing column is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
