"""Domain views bound to the generated test tables (see FIXTURES.md).

This module is the only place that knows about ``orders``, ``customer`` and
the other generated tables. Each view is a lazy DataFrame; Catalyst prunes
the parquet columns it does not use. In production the same views are read
from the support-desk tables directly (``sources.tables``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskpark.sources import schemas as S

PERSON_OFFSET = 1_000_000_000  # analyst persons are 1e9 + supplier key
DEFAULT_CLIENT = "NATION_0"     # plays the reference's fixed client name
DEFAULT_ASSIGNEE = "Supplier#000000003"  # plays the default assignee's name


def _case(expr: Column, pairs: list[tuple[object, object]], default: object = None) -> Column:
    out = None
    for key, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(expr == key, v) if out is None else out.when(expr == key, v)
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


def _line_id(number: Column, part: Column) -> Column:
    """Id of a line item: its order, number and part together."""
    return (F.col("l_orderkey") * 8 + number) * 10_000_000 + part


class TestData:
    """Views over ``<sf_dir>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ helpers
    @cached_property
    def line1(self) -> DataFrame:
        """One line per order (smallest line number) and its last ship date.

        An aggregate, not a window: partial aggregation before the shuffle.
        """
        li = self.raw("lineitem")
        first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first")
        return (li.groupBy("l_orderkey").agg(first, F.max("l_shipdate").alias("shipped"))
                .select("l_orderkey", F.col("first.l_partkey").alias("l_partkey"), F.col("first.l_suppkey").alias("l_suppkey"),
                        _line_id(F.col("first.l_linenumber"), F.col("first.l_partkey")).alias("line_id"), "shipped"))

    # ----------------------------------------------------------------- entities
    @cached_property
    def ticket(self) -> DataFrame:
        o = self.raw("orders")
        part = self.raw("part").select("p_partkey", "p_name")
        t = o.join(self.line1, o.o_orderkey == self.line1.l_orderkey, "left") \
             .join(part, F.col("p_partkey") == F.col("l_partkey"), "left")
        k, st = F.col("o_orderkey"), F.col("o_orderstatus")
        estado = (F.when(k % 11 == 0, None).when(st == "O", "aceptado").when(st == "F", "finalizado")
                  .when(k % 5 == 0, "cancelado").otherwise("en atención"))
        nivel = _case(F.col("o_orderpriority"),
                      [("5-LOW", "bajo"), ("3-MEDIUM", "medio"), ("2-HIGH", "alto"), ("1-URGENT", "crítico")])
        return S.conform(t.select(
            k.alias("id_ticket"), F.col("o_custkey").alias("id_colaborador"),
            F.col("line_id").alias("id_cliente_servicio"), F.col("l_suppkey").alias("id_analista"),
            F.col("p_name").alias("asunto"),
            F.when(k % 2 == 0, "incidencia").otherwise("solicitud").alias("tipo"),
            nivel.alias("nivel"), estado.alias("estado"),
            F.when((st == "F") & (k % 4 != 0), F.concat(F.lit("dx "), F.col("p_name"))).alias("diagnostico"),
            F.col("o_orderdate").alias("created_at"),
            F.when(st != "O", F.col("shipped")).alias("updated_at"),
            F.when((st == "F") & (k % 11 != 0), F.col("shipped")).alias("closed_at"),
        ), S.TICKET)

    @cached_property
    def cliente(self) -> DataFrame:
        n = self.raw("nation")
        return S.conform(n.select(F.col("n_nationkey").alias("id_cliente"), F.col("n_name").alias("nombre")),
                         S.CLIENTE)

    @cached_property
    def colaborador(self) -> DataFrame:
        c = self.raw("customer")
        return S.conform(c.select(F.col("c_custkey").alias("id_colaborador"), F.col("c_custkey").alias("id_persona"),
                                  F.col("c_nationkey").alias("id_cliente")), S.COLABORADOR)

    @cached_property
    def analista(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        return S.conform(s.select(k.alias("id_analista"), (k + PERSON_OFFSET).alias("id_persona"),
                                  _case(k % 50, [(1, 2), (2, 3)], 1).alias("nivel")), S.ANALISTA)

    @cached_property
    def external(self) -> DataFrame:
        c, s = self.raw("customer"), self.raw("supplier")
        ck, sk = F.col("c_custkey"), F.col("s_suppkey")
        google, no_hd = F.lit("google"), F.lit(None).cast("string")
        a = c.where(ck % 13 != 0).select(
            ck.alias("id_persona"), google.alias("provider"), ck.cast("string").alias("id_provider"),
            F.concat(F.lower("c_name"), F.lit("@example.test")).alias("correo"), F.col("c_name").alias("nombre"),
            no_hd.alias("hd"))
        b = c.where(ck % 17 == 1).select(
            ck.alias("id_persona"), google.alias("provider"), F.concat(F.lit("z"), ck.cast("string")).alias("id_provider"),
            F.lit("alt@example.test").alias("correo"), F.concat(F.lit("Alt "), F.col("c_name")).alias("nombre"),
            no_hd.alias("hd"))
        dup = c.where(ck % 97 == 5).select(
            (ck + 2 * PERSON_OFFSET).alias("id_persona"), google.alias("provider"), ck.cast("string").alias("id_provider"),
            F.lit("dup@example.test").alias("correo"), F.concat(F.lit("Dup "), F.col("c_name")).alias("nombre"),
            no_hd.alias("hd"))
        d = s.select(
            (sk + PERSON_OFFSET).alias("id_persona"), google.alias("provider"),
            F.concat(F.lit("s"), sk.cast("string")).alias("id_provider"),
            F.concat(F.lower("s_name"), F.lit("@example.test")).alias("correo"), F.col("s_name").alias("nombre"),
            no_hd.alias("hd"))
        return S.conform(a.unionByName(b).unionByName(dup).unionByName(d), S.EXTERNAL)

    @cached_property
    def servicio(self) -> DataFrame:
        p = self.raw("part")
        return S.conform(p.select(F.col("p_partkey").alias("id_servicio"), F.col("p_name").alias("nombre")),
                         S.SERVICIO)

    @cached_property
    def cliente_servicio(self) -> DataFrame:
        """Every line item is a contracted service; lines that agree in order, number and part are one."""
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
        cs = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")) \
                  .join(c, F.col("o_custkey") == F.col("c_custkey"))
        return S.conform(cs.select(_line_id(F.col("l_linenumber"), F.col("l_partkey")).alias("id_cliente_servicio"),
                                   F.col("c_nationkey").alias("id_cliente"),
                                   F.col("l_partkey").alias("id_servicio")), S.CLIENTE_SERVICIO)

    @cached_property
    def escalado(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "error")
        u = F.col("user_id")
        return S.conform(e.select(F.col("event_id").alias("id_escalado"), u.alias("id_ticket"),
                                  (u % 10).alias("id_analista_solicitante"),
                                  ((u + 1) % 10).alias("id_analista_derivado"),
                                  F.col("props").alias("motivo")), S.ESCALADO)

    @cached_property
    def mensaje(self) -> DataFrame:
        """Raw chat memory: every turn, system turns included, and further threads that hold system turns only."""
        cv = self.raw("conversations")
        own = cv.select(F.col("conv_id").alias("id_ticket"), "turn", "role", F.col("text").alias("content"))
        beyond = cv.agg(F.max("conv_id") + 1).scalar()
        system = cv.where(F.col("conv_id") % 20 == 7).select(
            (F.col("conv_id") + beyond).alias("id_ticket"), "turn", F.lit("system").alias("role"), F.col("text").alias("content"))
        return S.conform(own.unionByName(system), S.MENSAJE)

    @cached_property
    def kb_document(self) -> DataFrame:
        return S.conform(self.raw("documents"), S.KB_DOCUMENT)

    # ------------------------------------------------------ requests / commands
    @cached_property
    def kb_question(self) -> DataFrame:
        """Every user turn is a question, keyed by conversation and turn; turn -1 of some asks for an unknown word."""
        cv = self.raw("conversations").where(F.col("role") == "user")
        asked = cv.select("conv_id", "turn", F.col("text").alias("q"))
        unknown = cv.where(F.col("conv_id") % 25 == 3).select("conv_id").distinct().select(
            "conv_id", F.lit(-1).cast("bigint").alias("turn"), F.concat(F.lit("xqz"), F.col("conv_id").cast("string")).alias("q"))
        return S.conform(asked.unionByName(unknown), S.KB_QUESTION)

    @cached_property
    def search_req(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        q = _case(k % 5, [(0, "RED"), (1, "bolt"), (2, "%e_r"), (3, "")], "zzz")
        return S.conform(c.select(k.alias("id_colaborador"), q.alias("q")), S.SEARCH_REQ)

    @cached_property
    def owner_req(self) -> DataFrame:
        """Every collaborator asks for their own tickets."""
        return self.search_req.select("id_colaborador")

    @cached_property
    def lookup_req(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        return S.conform(o.select(
            k.alias("req_id"),
            F.when(k % 13 == 0, None).otherwise(F.col("o_custkey")).alias("id_colaborador"),
            F.when(k % 3 == 0, k + 1).otherwise(k).alias("id_ticket")), S.LOOKUP_REQ)

    @cached_property
    def inbox_req(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        persona = F.when(k % 9 == 4, k).otherwise(k + PERSON_OFFSET)
        status = _case(k % 7, [(1, "Todos"), (2, "Abierto"), (3, " Cerrado "), (4, "nada"), (5, ""),
                               (6, " todos ")])
        return S.conform(s.select(k.alias("req_id"), persona.alias("id_persona"), status.alias("status"),
                                  F.when(k % 31 == 8, 0).when(k % 31 == 9, 101).when(k % 31 == 10, None)
                                   .otherwise(_case(k % 3, [(0, 20), (1, 5)], 100)).alias("page_limit"),
                                  F.when(k % 31 == 11, -1).when(k % 31 == 12, None)
                                   .otherwise(_case(k % 4, [(1, 5), (2, 40)], 0)).alias("page_offset")), S.INBOX_REQ)

    @cached_property
    def intake_req(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return S.conform(c.select(
            k.alias("req_id"), k.alias("id_colaborador"), F.col("c_nationkey").alias("id_cliente"),
            _case(k % 4, [(0, "WIDGET"), (1, "red"), (2, "ring")], "nada").alias("nombre_servicio"),
            F.when(k % 33 == 4, "queja").when(k % 20 == 0, "incidencia").otherwise("solicitud").alias("tipo"),
            F.when(k % 35 == 6, None).when(k % 35 == 7, "urgente").otherwise("alto").alias("nivel"),
            F.concat(F.lit("Solicitud de "), F.col("c_name")).alias("asunto"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(F.lit(0), F.lit(0), k)).alias("ts"),
            k.alias("thread_id")), S.INTAKE_REQ)

    @cached_property
    def login(self) -> DataFrame:
        """Login feed with the token issuer: every purchase is an accepted login; further, later logins have other issuers or none."""
        e = self.raw("events").where(F.col("event_type") == "purchase")
        eid = F.col("event_id")
        own = e.select(
            eid.alias("login_id"), "ts", F.col("user_id").cast("string").alias("id_provider"),
            F.concat(F.lit("u"), eid.cast("string"), F.lit("@example.test")).alias("correo"),
            F.concat(F.lit("Login "), eid.cast("string")).alias("nombre"),
            F.when(eid % 2 == 0, "example.test").alias("hd"),
            _case(eid % 9, [(2, "accounts.google.com")], "https://accounts.google.com").alias("iss"))
        refused = e.where(eid % 9 == 5).select(
            (-eid - 1).alias("login_id"), (F.col("ts") + F.make_dt_interval(F.lit(1))).alias("ts"),
            F.col("user_id").cast("string").alias("id_provider"), F.lit("refused@example.test").alias("correo"),
            F.lit("Refused").alias("nombre"), F.lit(None).cast("string").alias("hd"),
            F.when(eid % 2 == 0, "https://issuer.example.test").alias("iss"))
        return S.conform(own.unionByName(refused), S.LOGIN_FEED)

    def _target(self, run: int) -> Column:
        """Ticket that an event's command names: runs of ``run`` events share one, and runs step over all order keys."""
        highest = self.raw("orders").agg(F.max("o_orderkey")).scalar()
        return F.floor(F.col("event_id") / run).cast("bigint") * 7919 % (highest + 1)

    @cached_property
    def status_cmd(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type").isin("click", "view"))
        l1 = self.line1.select("l_orderkey", "l_suppkey")
        eid, uid = F.col("event_id"), F.col("user_id")
        e = e.withColumn("target", self._target(4))
        j = e.join(l1, F.col("l_orderkey") == F.col("target"), "left")
        persona = (F.when(eid % 23 == 0, uid).when(eid % 4 == 0, PERSON_OFFSET + uid % 10)
                   .otherwise(F.coalesce(PERSON_OFFSET + F.col("l_suppkey"), F.lit(PERSON_OFFSET))))
        status = _case(eid % 9, [(0, "Abierto"), (1, " En Atención "), (2, "en atencion"), (3, "CERRADO"),
                                 (4, "finalizado"), (5, "Cancelado"), (6, "rechazado"), (7, "perdido")],
                       F.concat(F.lit("\t"), F.lit("abierto")))
        level = _case(eid % 7, [(0, "Alto"), (1, "critico"), (2, "urgente"), (3, " Medio "), (4, "")])
        description = F.when(eid % 5 == 0, "").when(eid % 5 < 3, F.col("props"))
        return S.conform(j.select(
            eid.alias("cmd_id"), "ts",
            (F.col("target") + F.when(eid % 97 == 0, PERSON_OFFSET).otherwise(0)).alias("id_ticket"),
            persona.alias("id_persona"), status.alias("status"), level.alias("level"),
            description.alias("description")), S.STATUS_CMD)

    @cached_property
    def escalation_cmd(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "signup")
        l1 = self.line1.select("l_orderkey", "l_suppkey")
        eid, uid = F.col("event_id"), F.col("user_id")
        e = e.withColumn("target", self._target(32))
        j = e.join(l1, F.col("l_orderkey") == F.col("target"), "left")
        persona = (F.when(eid % 23 == 0, uid).when(eid % 3 == 0, PERSON_OFFSET + 1)
                   .when(eid % 3 == 1, PERSON_OFFSET + 51)
                   .otherwise(F.coalesce(PERSON_OFFSET + F.col("l_suppkey"), F.lit(PERSON_OFFSET))))
        motivo = F.when(eid % 19 == 0, "corto").otherwise(F.concat(F.lit("motivo de derivacion "), F.col("props")))
        return S.conform(j.select(
            eid.alias("cmd_id"), "ts",
            (F.col("target") + F.when(eid % 97 == 0, PERSON_OFFSET).otherwise(0)).alias("id_ticket"),
            persona.alias("id_persona"), motivo.alias("motivo")), S.ESCALATION_CMD)
