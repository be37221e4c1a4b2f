"""Every analyst's paged inbox.

One request row = one call of the inbox endpoint: who asks, an optional
status word, ``limit`` and ``offset``. The plan: resolve the analyst, filter,
rank each list once, pick and hydrate only the page rows, project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.functions import vocab as V
from deskpark.operators import hydrate as H
from deskpark.plans.ranks import rank_in_groups


def analyst_of_person(analista: DataFrame) -> DataFrame:
    """id_persona -> id_analista, nivel (first analyst row of the person)."""
    return analista.groupBy("id_persona").agg(F.min(F.struct("id_analista", "nivel")).alias("a")).select(
        "id_persona", F.col("a.id_analista").alias("id_analista"), F.col("a.nivel").alias("analyst_level"))


def resolve_requests(requests: DataFrame, analista: DataFrame) -> DataFrame:
    """Attach analyst, wanted status and outcome code to each request.

    * ``status`` absent or empty, or equal to ``todos`` before stripping: no filter (T6).
    * page bounds outside 1..100 / >= 0: code 422; absent bounds default to 20 / 0 (F19).
    * a person who is not an analyst: code 200, total 0, no rows (T18), whatever the status word.
    * unknown status word: code 400, no page.
    """
    requests = (requests.withColumn("page_limit", F.coalesce("page_limit", F.lit(V.PAGE_LIMIT_DEFAULT)))
                        .withColumn("page_offset", F.coalesce("page_offset", F.lit(0))))
    st = F.col("status")
    no_filter = st.isNull() | (st == "") | (F.lower(st) == V.FILTER_ALL)
    wanted = F.when(no_filter, F.lit(None)).otherwise(X.status_from_ui(st))
    bad_page = ((F.col("page_limit") < 1) | (F.col("page_limit") > V.PAGE_LIMIT_MAX)
                | (F.col("page_offset") < 0))
    code = (F.when(bad_page, 422).when(F.col("id_analista").isNull(), 200)
            .when(~no_filter & wanted.isNull(), 400).otherwise(200))
    return (X.guard_ids(requests, "id_persona").join(analyst_of_person(analista), "id_persona", "left")
                    .select("req_id", "id_analista", "page_limit", "page_offset",
                            no_filter.alias("no_filter"), wanted.alias("wanted"), code.alias("code")))


def analyst_inbox(requests: DataFrame, ticket: DataFrame, analista: DataFrame, colaborador: DataFrame,
                  external: DataFrame, cliente: DataFrame, cliente_servicio: DataFrame,
                  servicio: DataFrame) -> DataFrame:
    """One row per page item; a request with an empty page gives one row of NULL items.

    Tickets are ranked once for each distinct list that is asked for (analyst, wanted status or all),
    however many requests ask for it; a request then picks the at most 100 ranks of its page by an
    equi-join. Ranks come from a distributed sort, so no task holds a hot analyst's list. Only the keys
    of the order are sorted and written; what a page shows is joined to the ids of its items.
    """
    req = resolve_requests(requests, analista).withColumn(
        "list", F.when(~F.col("no_filter"), F.col("wanted")).otherwise(F.lit(V.FILTER_ALL)))
    live = req.where((F.col("code") == 200) & F.col("id_analista").isNotNull())
    lists = live.select("id_analista", "list").distinct()
    # Equi-join on the analyst; the status filter is a residual on the joined row.
    keys = ticket.select("id_ticket", "id_analista", "estado", "updated_at")
    listed = keys.join(lists, "id_analista").where((F.col("list") == V.FILTER_ALL) | (F.col("estado") == F.col("list"))).drop("estado")
    # ORDER BY updated_at DESC (PostgreSQL: NULLs first, T1), id_ticket DESC as tie-break.
    order = [F.col("updated_at").desc_nulls_first(), F.col("id_ticket").desc()]
    ranked, totals = rank_in_groups(listed, ["id_analista", "list"], order, "_rank")
    places = live.select("req_id", "id_analista", "list", "page_offset", F.explode(F.sequence(
        F.lit(1), F.col("page_limit"))).alias("rn"))
    places = places.withColumn("_rank", F.col("page_offset") + F.col("rn")).drop("page_offset")
    found = places.join(ranked, ["id_analista", "list", "_rank"]).select("req_id", "rn", "id_ticket")
    page = found.join(ticket.select("id_ticket", "id_colaborador", "id_cliente_servicio", "asunto", "tipo", "estado",
                                    "created_at", "updated_at"), "id_ticket")
    req = req.join(totals.withColumnRenamed("n", "total"), ["id_analista", "list"], "left")
    items = H.hydrate_page(page, colaborador, external, cliente, cliente_servicio, servicio,
                           keep=("req_id", "rn"))
    return (req.join(items, "req_id", "left")
               .select("req_id", "code",
                       F.when(F.col("code") != 200, F.lit(None))
                        .otherwise(F.coalesce(F.col("total"), F.lit(0))).cast("bigint").alias("total"),
                       "page_limit", "page_offset", "rn", "id_ticket", "subject", "user", "service", "status",
                       "date", "updated_at"))
