"""The collaborator's ticket tools (F2-F5, F17, W2, A6, A7, X16, §2.13).

Requests are tables: ``owner_req(id_colaborador)`` asks for one's own
tickets, ``lookup_req(req_id, id_colaborador, id_ticket)`` for one ticket,
``search_req(id_colaborador, q)`` for a subject search. An id that did not
parse (NULL here) matches nothing (F17).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.functions import vocab as V
from deskpark.plans.materialize import materialize

# A reply is stored as ordered text parts; one part holds the cards of at most
# PART_SIZE consecutive ticket ids, so no group grows with a user's ticket count.
PART_SIZE = 1000

TICKET_COLS = ["id_colaborador", "id_ticket", "asunto", "nivel", "tipo", "estado", "created_at"]


def owned(ticket: DataFrame, owner_req: DataFrame) -> DataFrame:
    """Tickets of the requesting collaborators (semi join: no fan-out)."""
    return ticket.join(X.guard_ids(owner_req.select("id_colaborador"), "id_colaborador"), "id_colaborador",
                       "left_semi")


def open_tickets(ticket: DataFrame, owner_req: DataFrame) -> DataFrame:
    """``estado <> 'finalizado'``: NULL status is dropped, ``cancelado`` kept."""
    return owned(ticket, owner_req).where(F.col("estado") != V.STATUS_CLOSED).select(*TICKET_COLS)


def all_tickets(ticket: DataFrame, owner_req: DataFrame) -> DataFrame:
    return owned(ticket, owner_req).select(*TICKET_COLS)


def tickets_by_subject(ticket: DataFrame, search_req: DataFrame) -> DataFrame:
    """Case-insensitive *contains* on the subject, per owner.

    Equi-join on the owner with ``ILIKE`` as a residual: never tickets x
    patterns. Each distinct (owner, text) is matched once, so an owner who
    repeats a search does not multiply the scan of their tickets.
    """
    t = ticket.select("id_colaborador", "id_ticket", "asunto")
    req = X.guard_ids(search_req, "id_colaborador")
    # The pattern is built once for each distinct text, not for each joined row.
    texts = req.select("id_colaborador", "q").distinct().withColumn("_like", X.contains_pattern("q"))
    hits = texts.join(t, "id_colaborador").where(X.ilike(F.col("asunto"), F.col("_like")))
    return req.join(hits, ["id_colaborador", "q"]).select("id_colaborador", "q", "id_ticket", "asunto")


def recent_tickets(ticket: DataFrame, owner_req: DataFrame, k: int = V.RECENT_TICKETS) -> DataFrame:
    """Up to ``k`` newest tickets per collaborator.

    A literal ``rn <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a collaborator with many tickets ships only ``k`` rows per
    map task.
    """
    w = Window.partitionBy("id_colaborador").orderBy(F.col("created_at").desc_nulls_last(),
                                                     F.col("id_ticket").desc())
    return (owned(ticket, owner_req).withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") <= k).select("id_colaborador", "rn", "id_ticket", "asunto", "nivel", "estado",
                                            "created_at"))


def urgency_summary(ticket: DataFrame, owner_req: DataFrame) -> DataFrame:
    """Open tickets per collaborator, in total and per urgency."""
    open_t = open_tickets(ticket, owner_req)
    per_level = [F.count_if(F.col("nivel") == lv).alias(f"n_{name}")
                 for lv, name in zip(V.TICKET_LEVELS, ("bajo", "medio", "alto", "critico"))]
    agg = open_t.groupBy("id_colaborador").agg(F.count(F.lit(1)).alias("n_open"), *per_level)
    counts = ["n_open", "n_bajo", "n_medio", "n_alto", "n_critico"]
    return (owner_req.select("id_colaborador").join(agg, "id_colaborador", "left")
            .select("id_colaborador", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts]))


def sla_due(ticket: DataFrame) -> DataFrame:
    """Response deadline per ticket from its urgency."""
    return ticket.select("id_ticket", "nivel", "created_at",
                         X.sla_due(F.col("created_at"), F.col("nivel")).alias("due_at"))


def lookup_owned(lookup_req: DataFrame, ticket: DataFrame, cards_of) -> DataFrame:
    """One ticket by id *and* owner (F2); a miss gives the fixed sentence.

    ``cards_of(tickets) -> (id_ticket, card)`` renders cards for the matched
    tickets only.
    """
    lookup_req = X.guard_ids(lookup_req, "id_colaborador")
    hit = ticket.join(lookup_req.select("id_ticket", "id_colaborador"), ["id_ticket", "id_colaborador"],
                      "left_semi")
    cards = cards_of(hit).select("id_ticket", "id_colaborador", "card")
    miss = F.concat(F.lit(V.REPLY_ONE_MISSING.split("{id}")[0]), F.col("id_ticket").cast("string"),
                    F.lit(V.REPLY_ONE_MISSING.split("{id}")[1]))
    return (lookup_req.join(cards, ["id_ticket", "id_colaborador"], "left")
            .select("req_id", "id_ticket", F.col("card").isNotNull().alias("found"),
                    F.when(F.col("card").isNotNull(), F.concat(F.lit(V.REPLY_ONE_FOUND), F.col("card")))
                     .otherwise(miss).alias("reply")))


def reply_parts(requests: DataFrame, keys: list[str], cards: DataFrame, first: DataFrame, found_header: Column,
                empty_text: Column) -> DataFrame:
    """A tool reply listing many cards, as ordered text parts.

    The reply is ``header + '\n' + '\n\n'.join(cards ordered by id)``, or the
    empty sentence. It is returned as rows ``keys..., part, text`` whose texts,
    concatenated in ``part`` order, give the reply: part -1 is the header,
    part p holds the cards with ``id_ticket div PART_SIZE = p``. Each group is
    bounded by PART_SIZE cards however many tickets a user has. ``first``
    holds ``keys..., _first`` (the smallest listed ticket id per reply).
    """
    piece = F.concat(F.when(F.col("id_ticket") == F.col("_first"), F.lit("\n")).otherwise(F.lit("\n\n")),
                     F.col("card"))
    part = F.floor(F.col("id_ticket") / PART_SIZE).cast("bigint")
    body = (cards.join(first, keys)
                 .groupBy(*keys, part.alias("part"))
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id_ticket", piece.alias("p")))),
                                               lambda x: x["p"]), "").alias("text")))
    head = (requests.join(first, keys, "left")
            .select(*keys, F.lit(-1).cast("bigint").alias("part"),
                    F.when(F.col("_first").isNull(), empty_text).otherwise(found_header).alias("text")))
    return head.unionByName(body)


def ticket_digest(owner_req: DataFrame, ticket: DataFrame, cards_of) -> DataFrame:
    """Replies of the two listing tools, ``kind`` = ``open`` / ``all``.

    Cards are rendered once for all owned tickets; an open ticket's card is
    listed under both kinds. The first id of each reply comes from a ``min``
    over the ticket columns alone.
    """
    mine = owned(ticket, owner_req)
    is_open = F.col("estado") != V.STATUS_CLOSED
    firsts = mine.groupBy("id_colaborador").agg(F.min("id_ticket").alias("all"),
                                                F.min(F.when(is_open, F.col("id_ticket"))).alias("open"))
    first = (firsts.select("id_colaborador", F.explode(F.array(
                F.struct(F.lit("all").alias("kind"), F.col("all").alias("_first")),
                F.struct(F.lit("open").alias("kind"), F.col("open").alias("_first")))).alias("k"))
             .select("k.kind", "id_colaborador", "k._first").where(F.col("_first").isNotNull()))
    kinds = F.when(is_open, F.array(F.lit("open"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    cards = cards_of(mine).select(F.explode(kinds).alias("kind"), "id_colaborador", "id_ticket", "card")
    requests = (owner_req.select("id_colaborador").distinct()
                .select(F.explode(F.array(F.lit("open"), F.lit("all"))).alias("kind"), "id_colaborador"))
    is_open_kind = F.col("kind") == "open"
    found = F.when(is_open_kind, F.lit(V.REPLY_OPEN_FOUND)).otherwise(F.lit(V.REPLY_ALL_FOUND))
    empty = F.when(is_open_kind, F.lit(V.REPLY_OPEN_EMPTY)).otherwise(F.lit(V.REPLY_ALL_EMPTY))
    return reply_parts(requests, ["kind", "id_colaborador"], cards, first, found, empty) \
        .select("kind", "id_colaborador", "part", "text")


def subject_digest(search_req: DataFrame, ticket: DataFrame, cards_of) -> DataFrame:
    """Reply of the subject-search tool per (collaborator, text).

    One reply per distinct (collaborator, text). The hits are written once
    (they feed the first ids and the cards).
    """
    search_req = search_req.select("id_colaborador", "q").distinct()
    hits = materialize(tickets_by_subject(ticket, search_req).select("id_colaborador", "q", "id_ticket"))
    cards = cards_of(ticket.join(hits.select("id_ticket"), "id_ticket", "left_semi")).select("id_ticket", "card")
    keyed = hits.join(cards, "id_ticket")
    first = hits.groupBy("id_colaborador", "q").agg(F.min("id_ticket").alias("_first"))
    found = F.concat(F.lit(V.REPLY_SUBJECT_FOUND.split("{q}")[0]), F.col("q"),
                     F.lit(V.REPLY_SUBJECT_FOUND.split("{q}")[1]))
    empty = F.concat(F.lit(V.REPLY_SUBJECT_EMPTY.split("{q}")[0]), F.col("q"),
                     F.lit(V.REPLY_SUBJECT_EMPTY.split("{q}")[1]))
    return reply_parts(search_req.select("id_colaborador", "q"), ["id_colaborador", "q"], keyed, first, found,
                       empty).select("id_colaborador", "q", "part", "text")
