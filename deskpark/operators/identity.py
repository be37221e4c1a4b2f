"""Identity and role upserts as set operations.

The reference looks a login up, then inserts or updates one row. Over a
login feed: reduce the feed to the latest login per key (partial aggregate),
then one full outer join against the identities decides update / insert /
keep for every key at once. Parquet has no MERGE, so the result is the new
version of the table, written by the caller to a new directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.functions import vocab as V

KEY = ["provider", "id_provider"]


def accepted_logins(login: DataFrame) -> DataFrame:
    """Logins with their provider. When the feed carries the token issuer (``iss``), logins from issuers
    other than the accepted ones are dropped (F25)."""
    if "iss" in login.columns:
        login = login.where(F.col("iss").isin(*V.ACCEPTED_ISSUERS))
    return login.withColumn("provider", F.lit(V.PROVIDER))


def latest_login(login: DataFrame) -> DataFrame:
    """Latest accepted login per (provider, id_provider) by (ts, login_id)."""
    m = F.max_by(F.struct("login_id", "correo", "nombre", "hd"), F.struct("ts", "login_id")).alias("m")
    return (accepted_logins(login).groupBy(*KEY).agg(m)
            .select(*KEY, "m.login_id", "m.correo", "m.nombre", "m.hd"))


def identity_duplicates(external: DataFrame) -> DataFrame:
    """Keys held by more than one identity: ``.one()`` raises on them."""
    return (external.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def identity_upsert(external: DataFrame, login: DataFrame) -> DataFrame:
    """New version of ``external`` after the logins, with the action per row.

    * key known once: ``update`` correo, nombre, hd from the latest login;
    * key unknown: ``insert`` with a new person id (md5 of the key);
    * key known several times: ``duplicate``, rows unchanged (the login fails);
    * no login: ``keep``. A row with a NULL key matches no login and is kept.
    """
    # Only the few repeated keys are joined back, from the left: no row of the table can get lost.
    ext = external.join(identity_duplicates(external).withColumnRenamed("n", "_n"), KEY, "left")
    ext = ext.withColumn("_ext", F.lit(True))
    new = latest_login(login).select(*KEY, "login_id", F.col("correo").alias("l_correo"),
                                     F.col("nombre").alias("l_nombre"), F.col("hd").alias("l_hd"))
    j = ext.join(new, KEY, "full_outer")
    action = (F.when(F.col("_ext").isNull(), "insert").when(F.col("login_id").isNull(), "keep")
              .when(F.col("_n") > 1, "duplicate").otherwise("update"))
    take = F.col("_action").isin("insert", "update")
    return (j.withColumn("_action", action)
             .select(F.coalesce(F.col("id_persona"), X.md5_bigint(*KEY)).alias("id_persona"), *KEY,
                     F.when(take, F.col("l_correo")).otherwise(F.col("correo")).alias("correo"),
                     F.when(take, F.col("l_nombre")).otherwise(F.col("nombre")).alias("nombre"),
                     F.when(take, F.col("l_hd")).otherwise(F.col("hd")).alias("hd"),
                     F.col("_action").alias("action"), "login_id"))


def login_personas(external: DataFrame, login: DataFrame) -> DataFrame:
    """``provider, id_provider, id_persona``: the person that each key's successful logins resolve to.

    The reduced logins are joined to their own identities; the identity table is not rewritten for it.
    A key held by several identities has no row (its logins fail).
    """
    keys = accepted_logins(login).select(*KEY).distinct()
    known = external.select(*KEY, "id_persona", F.lit(1).alias("_one"))
    held = keys.join(known, KEY, "left").groupBy(*KEY).agg(
        F.count("_one").alias("_n"), F.min("id_persona").alias("_old"))
    return held.where(F.col("_n") <= 1).select(
        *KEY, F.coalesce(F.col("_old"), X.md5_bigint(*KEY)).alias("id_persona"))


def role_collaborator(personas: DataFrame, colaborador: DataFrame, cliente: DataFrame,
                      client_name: str = V.DEFAULT_CLIENT_NAME) -> DataFrame:
    """Collaborator role under the fixed client, created when absent.

    The client id is a scalar subquery (one row by construction); a missing
    client fails the job, as the reference answers 500.
    """
    client_id = cliente.where(F.col("nombre") == client_name).agg(F.min("id_cliente")).scalar()
    existing = (colaborador.where(F.col("id_cliente") == client_id)
                .groupBy("id_persona").agg(F.min("id_colaborador").alias("old_id")))
    p = personas.select("id_persona").distinct().join(existing, "id_persona", "left")
    checked = F.when(client_id.isNull(), F.raise_error(F.lit(f"client '{client_name}' does not exist"))) \
        .otherwise(client_id)
    return p.select("id_persona", checked.cast("bigint").alias("id_cliente"),
                    F.coalesce(F.col("old_id"), X.md5_bigint(F.lit("colaborador"), F.col("id_persona"), client_id))
                    .alias("id_colaborador"),
                    F.when(F.col("old_id").isNull(), "created").otherwise("existing").alias("action"))


def role_analyst(personas: DataFrame, analista: DataFrame) -> DataFrame:
    """Analyst role, created at level 1 when absent."""
    existing = analista.groupBy("id_persona").agg(F.min(F.struct("id_analista", "nivel")).alias("a"))
    p = personas.select("id_persona").distinct().join(existing, "id_persona", "left")
    return p.select("id_persona",
                    F.coalesce(F.col("a.id_analista"), X.md5_bigint(F.lit("analista"), F.col("id_persona")))
                    .alias("id_analista"),
                    F.coalesce(F.col("a.nivel"), F.lit(V.NEW_ANALYST_LEVEL)).alias("nivel"),
                    F.when(F.col("a").isNull(), "created").otherwise("existing").alias("action"))


def default_assignee(external: DataFrame, analista: DataFrame, name: str = V.DEFAULT_ASSIGNEE_NAME) -> DataFrame:
    """The analyst new tickets go to: person named ``name`` (any letter case), or NULL.

    One row always. The first matching identity is the smallest
    (provider, id_provider); its person's first analyst row is taken.
    """
    match = external.where(F.ilike(F.col("nombre"), F.lit(name)))
    first = match.agg(F.min_by("id_persona", F.struct(*KEY)).alias("id_persona"))
    an = analista.groupBy("id_persona").agg(F.min("id_analista").alias("id_analista"))
    return first.join(an, "id_persona", "left").select(F.lit(name).alias("assignee_name"), "id_analista")
