"""Ticket hydration: names of user, company, service and analyst.

The reference looks these up per page (two bulk queries) or per ticket (one
query per hop). Here every lookup is a join of the whole ticket set, planned by
Catalyst and AQE. Dimensions are joined by their primary keys; a person's
external identities, of which there may be several, are reduced to one *before*
joining, so a ticket never fans out (trap T4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.functions import vocab as V


def first_external(external: DataFrame) -> DataFrame:
    """One external identity per person: the smallest (provider, id_provider).

    The reference takes an arbitrary one (the page the last fetched, the
    detail the first). A ``min`` aggregate is partial before the shuffle.
    """
    m = F.min(F.struct("provider", "id_provider", "nombre", "correo")).alias("m")
    return external.groupBy("id_persona").agg(m).select(
        "id_persona", F.col("m.nombre").alias("ext_nombre"), F.col("m.correo").alias("ext_correo"))


def collaborator_profile(colaborador: DataFrame, external: DataFrame, cliente: DataFrame) -> DataFrame:
    """id_colaborador -> user, email, company (colaborador ⟕ external ⟕ cliente)."""
    cli = cliente.select("id_cliente", F.col("nombre").alias("company"))
    return (colaborador.select("id_colaborador", "id_persona", "id_cliente").join(first_external(external), "id_persona", "left")
                .join(cli, "id_cliente", "left")
                .select("id_colaborador", F.col("ext_nombre").alias("user"),
                        F.col("ext_correo").alias("email"), "company"))


def service_names(cliente_servicio: DataFrame, servicio: DataFrame) -> DataFrame:
    """id_cliente_servicio -> service name; ``has_service`` tells a missing hop."""
    srv = servicio.select("id_servicio", F.col("nombre").alias("service"), F.lit(True).alias("has_service"))
    return cliente_servicio.select("id_cliente_servicio", "id_servicio").join(srv, "id_servicio", "left").select("id_cliente_servicio", "service", "has_service")


def analyst_names(analista: DataFrame, external: DataFrame) -> DataFrame:
    """id_analista -> name of the analyst's first external identity.

    ``has_name`` is false when the analyst has no external identity: the card
    then prints the fallback, while a NULL name prints ``None`` (T11).
    """
    ext = first_external(external).withColumn("has_name", F.lit(True))
    return analista.select("id_analista", "id_persona").join(ext, "id_persona", "left").select(
        "id_analista", F.col("ext_nombre").alias("analyst_name"), "has_name")


def hydrate_page(tickets: DataFrame, colaborador: DataFrame, external: DataFrame, cliente: DataFrame,
                 cliente_servicio: DataFrame, servicio: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """List form of a hydrated ticket (P2). Empty service names become NULL.

    ``keep`` names columns of ``tickets`` to carry through (request keys).
    """
    prof = collaborator_profile(colaborador, external, cliente)
    svc = service_names(cliente_servicio, servicio)
    return (tickets.join(prof, "id_colaborador", "left")
                   .join(svc, "id_cliente_servicio", "left")
                   .select(*keep, F.col("id_ticket"), F.col("asunto").alias("subject"), F.col("estado").alias("status"),
                           F.col("tipo").alias("type"), X.ddmmyyyy("created_at").alias("date"),
                           F.col("updated_at"), F.col("user"), F.col("email"), F.col("company"),
                           F.nullif(F.col("service"), F.lit("")).alias("service")))


def latest_escalation(escalado: DataFrame) -> DataFrame:
    """Reason of the escalation with the greatest id, per ticket.

    ``max_by`` keeps a NULL reason, as ``ORDER BY id DESC LIMIT 1`` does.
    """
    return escalado.groupBy("id_ticket").agg(
        F.max_by("motivo", "id_escalado").alias("escalation_reason"))


def ticket_detail(tickets: DataFrame, colaborador: DataFrame, external: DataFrame, cliente: DataFrame,
                  cliente_servicio: DataFrame, servicio: DataFrame, escalado: DataFrame,
                  conversacion_json: DataFrame) -> DataFrame:
    """Detail form (P3): list form plus level, diagnosis, escalation, conversation.

    Unlike the list form, the detail keeps an empty service name but drops an
    empty escalation reason (T17). A ticket without a stored conversation gets
    ``[]`` (T13).
    """
    prof = collaborator_profile(colaborador, external, cliente)
    svc = service_names(cliente_servicio, servicio)
    esc = latest_escalation(escalado)
    conv = conversacion_json.select("id_ticket", F.col("contenido").alias("conversation"))
    return (tickets.join(prof, "id_colaborador", "left")
                   .join(svc, "id_cliente_servicio", "left")
                   .join(esc, "id_ticket", "left")
                   .join(conv, "id_ticket", "left")
                   .select(F.col("id_ticket"), F.col("asunto").alias("subject"), F.col("tipo").alias("type"),
                           F.col("user"), F.col("company"), F.col("service"), F.col("email"),
                           X.ddmmyyyy("created_at").alias("date"), F.col("estado").alias("status"),
                           F.coalesce(F.col("conversation"), F.lit("[]")).alias("conversation"),
                           F.col("updated_at"), F.col("nivel").alias("level"),
                           F.col("diagnostico").alias("description"),
                           F.nullif(F.col("escalation_reason"), F.lit("")).alias("escalation_reason")))


def ticket_cards(tickets: DataFrame, analista: DataFrame, external: DataFrame,
                 cliente_servicio: DataFrame, servicio: DataFrame) -> DataFrame:
    """The text block the ticket tools print for one ticket."""
    names = analyst_names(analista, external)
    svc = service_names(cliente_servicio, servicio)
    t = tickets.join(names, "id_analista", "left").join(svc, "id_cliente_servicio", "left")
    analyst = F.when(F.col("has_name"), X.py_str("analyst_name")).otherwise(F.lit(V.CARD_NO_ANALYST))
    service = F.when(F.col("has_service"), X.py_str("service")).otherwise(F.lit(V.CARD_NO_SERVICE))
    date = F.coalesce(X.ddmmyyyy("created_at"), F.lit(V.CARD_NO_DATE))
    # FIXED VALUES: card labels and layout (no line break before Analista and Fecha).
    card = F.concat(
        F.lit("  - **ID:** #"), F.col("id_ticket").cast("string"),
        F.lit("\n  - **Asunto:** "), X.py_str("asunto"),
        F.lit("\n  - **Servicio:** "), service,
        F.lit("\n  - **Nivel:** "), X.py_str("nivel"),
        F.lit("\n  - **Tipo:** "), X.py_str("tipo"),
        F.lit("\n  - **Estado:** "), X.py_str("estado"),
        F.lit("  - **Analista:** "), analyst,
        F.lit("  - **Fecha de Creación:** "), date,
        F.when((F.col("estado") == V.STATUS_CLOSED) & (F.length("diagnostico") > 0),
               F.concat(F.lit("\n  - **Diagnóstico:** "), F.col("diagnostico"))).otherwise(F.lit("")),
    )
    return t.select("id_ticket", "id_colaborador", "estado", card.alias("card"))
