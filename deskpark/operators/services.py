"""Contracted services and user context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.functions import vocab as V
from deskpark.operators.identity import KEY, accepted_logins, login_personas, role_collaborator
from deskpark.operators.tickets import PART_SIZE


def client_services(cliente_servicio: DataFrame, servicio: DataFrame) -> DataFrame:
    """Services of every client, one row per (client, service).

    The reference reads them as ORM entities, which come back de-duplicated
    by primary key, so a service contracted twice is listed once.
    """
    pairs = cliente_servicio.select("id_cliente", "id_servicio").distinct()
    return pairs.join(servicio, "id_servicio").select(
        "id_cliente", F.col("id_servicio").cast("string").alias("id_servicio"), "nombre")


def service_list_parts(cliente: DataFrame, cliente_servicio: DataFrame, servicio: DataFrame) -> DataFrame:
    """``', '.join(service names)`` per client, ordered by service id, as bounded parts (A5).

    Rows ``id_cliente, part, text``: part p holds the names of the services
    with ``id_servicio div PART_SIZE = p``; concatenating ``text`` in part
    order gives the joined list. The first name of a client carries no
    leading separator (its id comes from a ``min`` aggregate), so no group
    ever holds a client's whole list. A client without a named service has
    one row: part 0, ``Ninguno``.
    """
    named = (cliente_servicio.select("id_cliente", "id_servicio").distinct()
             .join(servicio.where(F.col("nombre").isNotNull()), "id_servicio"))
    first = named.groupBy("id_cliente").agg(F.min("id_servicio").alias("_first"))
    piece = F.concat(F.when(F.col("id_servicio") == F.col("_first"), F.lit("")).otherwise(F.lit(", ")),
                     F.col("nombre"))
    part = F.floor(F.col("id_servicio") / PART_SIZE).cast("bigint")
    items = F.array_sort(F.collect_list(F.struct("id_servicio", piece.alias("p"))))
    listed = (named.join(first, "id_cliente").groupBy("id_cliente", part.alias("part"))
              .agg(F.array_join(F.transform(items, lambda x: x["p"]), "").alias("text")))
    without = cliente.select("id_cliente").distinct().join(first, "id_cliente", "left_anti").select(
        "id_cliente", F.lit(0).cast("bigint").alias("part"), F.lit(V.NO_SERVICES).alias("text"))
    return listed.unionByName(without)


def service_resolve(intake_req: DataFrame, cliente_servicio: DataFrame, servicio: DataFrame) -> DataFrame:
    """First contracted service of the client whose name contains the asked text.

    Service lines are first reduced to one row per (client, service name)
    with the smallest line id, and requests to one row per (client, asked
    text): each distinct text is tested against each distinct name of its
    client once, however many lines carry the name or requests ask the text.
    """
    named = (cliente_servicio.join(servicio, "id_servicio")
             .groupBy("id_cliente", "nombre").agg(F.min("id_cliente_servicio").alias("first_cs")))
    req = intake_req.select("req_id", "id_cliente", "nombre_servicio")
    texts = (req.select("id_cliente", "nombre_servicio").distinct()
             .withColumn("_like", X.contains_pattern("nombre_servicio")))
    hits = (texts.join(named, "id_cliente")
                 .where(X.ilike(F.col("nombre"), F.col("_like")))
                 .groupBy("id_cliente", "nombre_servicio").agg(F.min("first_cs").alias("id_cliente_servicio")))
    return req.join(hits, ["id_cliente", "nombre_servicio"], "left").select("req_id", "id_cliente_servicio")


# FIXED VALUES: the context block handed to the agent, whitespace included.
CONTEXT_HEAD = ("\n    CONTEXTO DEL USUARIO ACTUAL:\n    - Nombre del usuario: {nombre}"
                "\n    - Empresa del usuario: {cliente}\n    - Servicios contratados por la empresa: ")
CONTEXT_TAIL = "\n    "


def _context_head(nombre, cliente_nombre):
    a, rest = CONTEXT_HEAD.split("{nombre}")
    b, c = rest.split("{cliente}")
    return F.concat(F.lit(a), X.py_str(nombre), F.lit(b), X.py_str(cliente_nombre), F.lit(c))


def user_context(login: DataFrame, external: DataFrame, colaborador: DataFrame, cliente: DataFrame,
                 cliente_servicio: DataFrame, servicio: DataFrame,
                 client_name: str = V.DEFAULT_CLIENT_NAME) -> DataFrame:
    """Token claims and context block of every login, as collaborator and as analyst.

    Name and mail are those of the login itself; the collaborator role is the one under the fixed
    client, created when absent. The context block is ``context_head + services + context_tail`` where
    ``services`` is the client's ``service_list_parts`` concatenated in part order (``Ninguno`` for a
    client without any, and for analysts, whose row has no client). The list itself is kept per client
    (not copied into every login's row).
    """
    personas = login_personas(external, login)
    who = accepted_logins(login).join(personas, KEY).select("login_id", "id_persona", "nombre", "correo")
    names = cliente.select("id_cliente", F.col("nombre").alias("cli_nombre"), F.lit(True).alias("has_cli"))
    with_services = (cliente_servicio.join(servicio.where(F.col("nombre").isNotNull()).select("id_servicio"), "id_servicio")
                     .groupBy("id_cliente").agg(F.lit(True).alias("has_services")))
    roles = (role_collaborator(personas, colaborador, cliente, client_name)
             .join(names, "id_cliente", "left").join(with_services, "id_cliente", "left"))
    col = who.join(roles, "id_persona")
    cli_name = F.when(F.col("has_cli"), F.col("cli_nombre")).otherwise(F.lit(V.UNKNOWN_CLIENT))
    persona = F.col("id_persona").cast("string").alias("persona_id")
    collab = col.select(
        "login_id", F.lit("colaborador").alias("kind"), persona,
        F.col("id_colaborador").cast("string").alias("colaborador_id"),
        F.col("id_cliente").cast("string").alias("cliente_id"), "nombre", "correo",
        cli_name.alias("cliente_nombre"), F.coalesce(F.col("has_services"), F.lit(False)).alias("has_services"),
        _context_head(F.col("nombre"), cli_name).alias("context_head"),
        F.lit(CONTEXT_TAIL).alias("context_tail"))
    analysts = who.select(
        "login_id", F.lit("analista").alias("kind"), persona,
        F.lit(V.ZERO_UUID).alias("colaborador_id"), F.lit(V.ZERO_UUID).alias("cliente_id"), "nombre", "correo",
        F.lit(V.ANALYST_CLIENT_NAME).alias("cliente_nombre"), F.lit(False).alias("has_services"),
        _context_head(F.col("nombre"), F.lit(V.ANALYST_CLIENT_NAME)).alias("context_head"),
        F.lit(CONTEXT_TAIL).alias("context_tail"))
    return collab.unionByName(analysts)
