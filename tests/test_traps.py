"""Hand-made rows for the semantic traps of the reference."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from deskpark.functions import text as X
from deskpark.operators import commands as CM
from deskpark.operators import escalation as ES
from deskpark.operators import hydrate as H
from deskpark.operators import identity as ID
from deskpark.operators import inbox as I
from deskpark.operators import intake as IN
from deskpark.operators import tickets as T
from deskpark.operators import transcripts as TR
from deskpark.sources import schemas as S

D = dt.datetime


def df(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def ticket_row(i, colab=1, cs=None, analyst=None, asunto="s", tipo="solicitud", nivel="alto", estado="aceptado",
               diag=None, created=D(2024, 1, 1), updated=None, closed=None):
    return (i, colab, cs, analyst, asunto, tipo, nivel, estado, diag, created, updated, closed)


@pytest.fixture(scope="module")
def dims(spark):
    cliente = df(spark, S.CLIENTE, [(1, "ACME")])
    colaborador = df(spark, S.COLABORADOR, [(1, 100, 1), (2, 200, 1)])
    analista = df(spark, S.ANALISTA, [(10, 1010, 1), (11, 1011, 1), (20, 1020, 2), (30, 1030, 3), (12, 1012, 1)])
    external = df(spark, S.EXTERNAL, [
        (100, "google", "b", "b@x", "Bee", None), (100, "google", "a", "a@x", "Ay", None),
        (100, "other", "0", "o@x", "Oh", None),
        (1010, "google", "s10", "s10@x", "Ana", None), (1011, "google", "s11", "s11@x", None, None),
        (1020, "google", "s20", "s20@x", "Senior", None), (1030, "google", "s30", "s30@x", "Lead", None)])
    servicio = df(spark, S.SERVICIO, [(7, "Portal"), (8, "")])
    cliente_servicio = df(spark, S.CLIENTE_SERVICIO, [(70, 1, 7), (80, 1, 8), (90, 1, 99)])
    return dict(cliente=cliente, colaborador=colaborador, analista=analista, external=external,
                servicio=servicio, cliente_servicio=cliente_servicio)


# ---------------------------------------------------------------- T1, T2, T6, T18
def test_inbox_order_nulls_first_and_tie_break(spark, dims):
    tickets = df(spark, S.TICKET, [
        ticket_row(1, analyst=10, updated=D(2024, 1, 5)), ticket_row(2, analyst=10, updated=None),
        ticket_row(3, analyst=10, updated=D(2024, 1, 5)), ticket_row(4, analyst=10, updated=None),
        ticket_row(5, analyst=10, updated=D(2024, 1, 9))])
    reqs = df(spark, S.INBOX_REQ, [(1, 1010, None, 2, 0), (2, 1010, None, 2, 2), (3, 1010, None, 2, 4),
                                   (4, 1010, None, 100, 0), (5, 999, None, 20, 0)])
    out = I.analyst_inbox(reqs, tickets, dims["analista"], dims["colaborador"], dims["external"],
                          dims["cliente"], dims["cliente_servicio"], dims["servicio"])
    rows = {(r.req_id, r.rn): r for r in out.collect()}
    full = [rows[(4, k)].id_ticket for k in range(1, 6)]
    assert full == [4, 2, 5, 3, 1]  # NULL updated_at first, then newest; ties by id desc
    pages = [rows[(1, 1)].id_ticket, rows[(1, 2)].id_ticket, rows[(2, 1)].id_ticket, rows[(2, 2)].id_ticket,
             rows[(3, 1)].id_ticket]
    assert pages == full  # pages are disjoint and cover the inbox
    assert all(r.total == 5 for r in rows.values() if r.req_id != 5)
    non_analyst = rows[(5, None)]
    assert non_analyst.total == 0 and non_analyst.id_ticket is None and non_analyst.code == 200


def test_inbox_status_filter_words(spark, dims):
    tickets = df(spark, S.TICKET, [ticket_row(1, analyst=10, estado="finalizado"),
                                   ticket_row(2, analyst=10, estado="aceptado")])
    reqs = df(spark, S.INBOX_REQ, [(1, 1010, "todos", 20, 0), (2, 1010, " todos ", 20, 0), (3, 1010, "", 20, 0),
                                   (4, 1010, "xyz", 20, 0), (5, 1010, "\tCerrado\n", 20, 0), (6, 1010, "TODOS", 20, 0)])
    out = I.analyst_inbox(reqs, tickets, dims["analista"], dims["colaborador"], dims["external"],
                          dims["cliente"], dims["cliente_servicio"], dims["servicio"])
    by_req = {}
    for r in out.collect():
        by_req.setdefault(r.req_id, []).append(r)
    assert by_req[1][0].total == 2 and by_req[3][0].total == 2 and by_req[6][0].total == 2
    assert by_req[2][0].code == 400 and by_req[2][0].id_ticket is None  # ' todos ' is compared unstripped
    assert by_req[4][0].code == 400
    assert [r.id_ticket for r in by_req[5]] == [1]


def test_inbox_page_defaults_and_bounds(spark, dims):
    tickets = df(spark, S.TICKET, [ticket_row(i, analyst=10, updated=D(2024, 1, i)) for i in range(1, 26)])
    reqs = df(spark, S.INBOX_REQ, [(1, 1010, None, None, None), (2, 1010, None, 0, 0), (3, 1010, None, 101, 0),
                                   (4, 1010, None, 5, -1), (5, 1010, None, 5, 30)])
    out = I.analyst_inbox(reqs, tickets, dims["analista"], dims["colaborador"], dims["external"],
                          dims["cliente"], dims["cliente_servicio"], dims["servicio"]).collect()
    by = {}
    for r in out:
        by.setdefault(r.req_id, []).append(r)
    assert len(by[1]) == 20 and by[1][0].page_limit == 20 and by[1][0].total == 25
    assert [by[k][0].code for k in (2, 3, 4)] == [422, 422, 422]
    assert len(by[5]) == 1 and by[5][0].id_ticket is None and by[5][0].total == 25  # offset past the end


# ---------------------------------------------------------------- T3
def test_open_keeps_cancelled_drops_null(spark):
    tickets = df(spark, S.TICKET, [ticket_row(1, estado=None), ticket_row(2, estado="cancelado"),
                                   ticket_row(3, estado="finalizado"), ticket_row(4, estado="en atención")])
    owners = spark.createDataFrame([(1,)], "id_colaborador bigint")
    got = sorted(r.id_ticket for r in T.open_tickets(tickets, owners).collect())
    assert got == [2, 4]


# ---------------------------------------------------------------- T4
def test_first_external_is_smallest_key(spark, dims):
    prof = H.collaborator_profile(dims["colaborador"], dims["external"], dims["cliente"])
    r = {x.id_colaborador: x for x in prof.collect()}
    assert (r[1].user, r[1].email, r[1].company) == ("Ay", "a@x", "ACME")
    assert r[2].user is None and r[2].company == "ACME"  # no external: still one row


def test_hydration_never_fans_out(mid):
    t = mid.ticket
    h = H.hydrate_page(t, mid.colaborador, mid.external, mid.cliente, mid.cliente_servicio, mid.servicio)
    assert h.count() == t.count()


# ---------------------------------------------------------------- T5
def _pg_ilike_contains(subject, q):
    """PostgreSQL ILIKE '%q%' with the default backslash escape."""
    pattern, out, i = "%" + q + "%", "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out += re.escape(pattern[i + 1])
            i += 2
            continue
        out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.fullmatch(out, subject, flags=re.S | re.I) is not None


def test_ilike_wildcards_and_backslashes(spark):
    subjects = ["100% listo", "a_b", "C:\\dir", "axb", "plain", "ABC"]
    texts = ["%", "_", "\\", "a\\x", "", "b\\", "abc"]
    rows = [(s, q) for s in subjects for q in texts]
    got = spark.createDataFrame(rows, "s string, q string").select(
        "s", "q", X.ilike_contains(F.col("s"), F.col("q")).alias("m")).collect()
    for r in got:
        assert r.m == _pg_ilike_contains(r.s, r.q), (r.s, r.q)


# ---------------------------------------------------------------- X1
def test_py_strip_matches_python(spark):
    words = ["\t abierto\n", "\u00a0cerrado\u2003", " En Atención ", "x", "", "\x1cfin\x85"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(X.py_strip("w").alias("s")).collect()
    assert [r.s for r in got] == [w.strip() for w in words]


# ---------------------------------------------------------------- T7, T8, T15
def test_status_fold_sequence(spark, dims):
    long_text = "x" * 5001
    tickets = df(spark, S.TICKET, [ticket_row(1, analyst=10, updated=D(2024, 1, 1)),
                                   ticket_row(2, analyst=None, estado="aceptado")])
    cmds = df(spark, S.STATUS_CMD, [
        (1, D(2024, 2, 1), 1, 1010, "Cerrado", "urgente", "arreglado"),      # status ok, bad level
        (2, D(2024, 2, 2), 1, 1010, "Abierto", None, None),                 # reopen keeps closed_at
        (3, D(2024, 2, 3), 1, 1010, " CERRADO ", " Medio ", ""),            # empty text: no new diagnosis
        (4, D(2024, 2, 4), 1, 1011, "cerrado", None, "otro"),               # not the assignee
        (5, D(2024, 2, 5), 2, 1010, "cerrado", None, "x"),                  # unassigned ticket
        (6, D(2024, 2, 6), 1, 1010, "perdido", None, None),                 # unknown status
        (7, D(2024, 2, 7), 1, 1010, "finalizado", None, long_text),         # truncated diagnosis
        (8, D(2024, 2, 8), 3, 1010, "cerrado", None, None),                 # no such ticket
        (9, D(2024, 2, 9), 1, 555, "cerrado", None, None),                  # not an analyst
    ])
    v = {r.cmd_id: r for r in CM.status_validate(cmds, dims["analista"], tickets).collect()}
    assert (v[1].status_code, v[1].level_code) == (200, 400)
    assert (v[3].status_code, v[3].level_code) == (200, 200)
    assert [v[i].status_code for i in (4, 5, 6, 8, 9)] == [403, 403, 400, 404, 403]
    new = {r.id_ticket: r for r in CM.status_apply(tickets, CM.status_validate(cmds, dims["analista"], tickets))
           .collect()}
    t1 = new[1]
    assert t1.estado == "finalizado" and t1.nivel == "medio"
    assert t1.closed_at == D(2024, 2, 7) and t1.updated_at == D(2024, 2, 7)
    assert t1.diagnostico == "x" * 5000
    assert new[2].estado == "aceptado" and new[2].updated_at is None


def test_status_fold_reopen_keeps_closed_at(spark, dims):
    tickets = df(spark, S.TICKET, [ticket_row(1, analyst=10)])
    cmds = df(spark, S.STATUS_CMD, [(1, D(2024, 2, 1), 1, 1010, "cerrado", None, "ok"),
                                    (2, D(2024, 2, 2), 1, 1010, "abierto", None, None)])
    t1 = CM.status_apply(tickets, CM.status_validate(cmds, dims["analista"], tickets)).collect()[0]
    assert t1.estado == "aceptado" and t1.closed_at == D(2024, 2, 1) and t1.diagnostico == "ok"


# ---------------------------------------------------------------- T9, 409, C4 order
def test_escalation_codes_and_untouched_fields(spark, dims):
    tickets = df(spark, S.TICKET, [ticket_row(1, analyst=10, updated=D(2024, 1, 3), estado="en atención"),
                                   ticket_row(2, analyst=30)])
    cmds = df(spark, S.ESCALATION_CMD, [
        (1, D(2024, 2, 1), 1, 1010, "necesita ayuda senior"),   # moves 10 -> a senior analyst
        (2, D(2024, 2, 2), 1, 1010, "otra vez por favor"),      # 10 is no longer the assignee
        (3, D(2024, 2, 3), 1, 1010, "corto"),                   # 422 first
        (4, D(2024, 2, 4), 2, 1030, "nivel tres intenta"),      # level 3 may not escalate
        (5, D(2024, 2, 5), 9, 1010, "ticket inexistente"),      # 404
        (6, D(2024, 2, 6), 1, 999, "persona sin rol"),          # 403 not an analyst
    ])
    v = {r.cmd_id: r for r in ES.escalation_validate(cmds, dims["analista"], tickets).collect()}
    assert [v[i].code for i in range(1, 7)] == [200, 403, 422, 403, 404, 403]
    assert v[1].id_analista_derivado in (20, 30)
    new = {r.id_ticket: r for r in ES.escalation_apply(tickets, ES.escalation_validate(
        cmds, dims["analista"], tickets)).collect()}
    assert new[1].id_analista == v[1].id_analista_derivado
    assert new[1].updated_at == D(2024, 1, 3) and new[1].estado == "en atención"


def test_escalation_without_senior_is_409(spark):
    analista = df(spark, S.ANALISTA, [(10, 1010, 1), (11, 1011, 1)])
    tickets = df(spark, S.TICKET, [ticket_row(1, analyst=10)])
    cmds = df(spark, S.ESCALATION_CMD, [(1, D(2024, 2, 1), 1, 1010, "no hay nadie arriba")])
    assert ES.escalation_validate(cmds, analista, tickets).collect()[0].code == 409


def test_candidates_are_senior(mid):
    c = ES.escalation_candidates(mid.escalation_cmd, mid.analista)
    lv = mid.analista.select(F.col("id_analista").alias("id_candidate"), F.col("nivel").alias("cand_level"))
    bad = c.join(lv, "id_candidate").where(F.col("cand_level") <= F.col("issuer_level")).count()
    assert bad == 0
    assert c.where(F.col("n_candidates") > 0).where(F.col("id_candidate").isNull()).count() == 0


# ---------------------------------------------------------------- T10
def test_latest_escalation_by_id_keeps_null(spark):
    esc = df(spark, S.ESCALADO, [(1, 5, 1, 2, "primero"), (3, 5, 1, 2, None), (2, 5, 1, 2, "medio"),
                                 (4, 6, 1, 2, "a"), (7, 6, 1, 2, "")])
    got = {r.id_ticket: r.escalation_reason for r in H.latest_escalation(esc).collect()}
    assert got == {5: None, 6: ""}


# ---------------------------------------------------------------- T11, T12
def test_card_text_fallbacks(spark, dims):
    tickets = df(spark, S.TICKET, [
        ticket_row(1, analyst=None, cs=70), ticket_row(2, analyst=12, cs=90),
        ticket_row(3, analyst=11, cs=80, estado="finalizado", diag=""),
        ticket_row(4, analyst=10, cs=None, estado="finalizado", diag="hecho", created=None, asunto=None)])
    c = {r.id_ticket: r.card for r in H.ticket_cards(tickets, dims["analista"], dims["external"],
                                                       dims["cliente_servicio"], dims["servicio"]).collect()}
    assert "**Analista:** Aún no asignado" in c[1] and "**Servicio:** Portal" in c[1]
    assert "**Analista:** Aún no asignado" in c[2] and "**Servicio:** No disponible" in c[2]
    assert "**Analista:** None" in c[3] and "**Servicio:** \n" in c[3] and "Diagnóstico" not in c[3]
    assert c[4].endswith("  - **Analista:** Ana  - **Fecha de Creación:** -\n  - **Diagnóstico:** hecho")
    assert "**Asunto:** None" in c[4]
    assert c[1] == ("  - **ID:** #1\n  - **Asunto:** s\n  - **Servicio:** Portal\n  - **Nivel:** alto\n"
                    "  - **Tipo:** solicitud\n  - **Estado:** aceptado  - **Analista:** Aún no asignado"
                    "  - **Fecha de Creación:** 01/01/2024")


# ---------------------------------------------------------------- T13, T17
def test_detail_conversation_and_empty_values(spark, dims):
    tickets = df(spark, S.TICKET, [ticket_row(1, cs=80), ticket_row(2, cs=70), ticket_row(3, cs=70)])
    msgs = df(spark, S.MENSAJE, [(2, 0, "system", "ctx"), (3, 1, "assistant", "hola"), (3, 0, "user", "ayuda"),
                                 (3, 2, "tool", "x")])
    esc = df(spark, S.ESCALADO, [(1, 1, 10, 20, "")])
    det = {r.id_ticket: r for r in H.ticket_detail(tickets, dims["colaborador"], dims["external"], dims["cliente"],
                                                     dims["cliente_servicio"], dims["servicio"], esc,
                                                     TR.transcripts(msgs)).collect()}
    assert det[1].conversation == "[]" and det[1].service == "" and det[1].escalation_reason is None
    assert det[2].conversation == "[]"
    assert det[3].conversation == '[{"role":"user","content":"ayuda"},{"role":"agent","content":"hola"}]'
    page = {r.id_ticket: r for r in H.hydrate_page(tickets, dims["colaborador"], dims["external"], dims["cliente"],
                                                     dims["cliente_servicio"], dims["servicio"]).collect()}
    assert page[1].service is None and page[2].service == "Portal"


# ---------------------------------------------------------------- T16, X6, C6
def test_intake_without_default_assignee(spark, dims):
    reqs = df(spark, S.INTAKE_REQ, [(1, 1, 1, "portal", "incidencia", "alto", "No entra", D(2024, 3, 1, 8, 5, 9), 7),
                                    (2, 1, 1, "nada", "solicitud", "bajo", "Otro", D(2024, 3, 1), 8),
                                    (3, 1, 1, "portal", "queja", "bajo", "Tipo malo", D(2024, 3, 2), 9)])
    tickets = df(spark, S.TICKET, [ticket_row(41)])
    out = IN.ticket_intake(reqs, tickets, dims["cliente_servicio"], dims["servicio"], dims["external"],
                           dims["analista"], "Nadie Con Ese Nombre")
    r = {x.req_id: x for x in out.collect()}
    assert (r[1].outcome, r[1].id_ticket, r[1].id_analista, r[1].estado) == ("created", 42, None, "aceptado")
    assert r[2].outcome == "rejected" and r[2].id_ticket is None
    assert r[3].outcome == "invalid"
    rec = {x.req_id: x.reply for x in IN.ticket_receipts(out).collect()}
    assert rec[1] == ("He generado el ticket **#42** con su solicitud. "
                      "Fecha de creación del ticket: 01/03/2024 08:05:09.")
    assert rec[2] == "Lo siento, ocurrió un error inesperado al intentar crear su ticket."
    turns = df(spark, S.MENSAJE, [(7, 0, "system", "ctx"), (7, 1, "user", "no entra"), (8, 0, "user", "x")])
    conv = TR.intake_conversations(out, turns.withColumnRenamed("id_ticket", "thread_id")).collect()
    assert [(c.id_ticket, c.contenido) for c in conv] == [(42, '[{"role":"user","content":"no entra"}]')]


def test_default_assignee_case_insensitive(spark, dims):
    assert ID.default_assignee(dims["external"], dims["analista"], "ANA").collect()[0].id_analista == 10
    assert ID.default_assignee(dims["external"], dims["analista"], "nobody").collect()[0].id_analista is None


# ---------------------------------------------------------------- A8, S9
def test_identity_duplicates_and_upsert(spark):
    ext = df(spark, S.EXTERNAL, [(1, "google", "k1", "a@x", "A", None), (2, "google", "k1", "b@x", "B", None),
                                 (3, "google", "k2", "c@x", "C", None), (4, "google", "k3", "d@x", "D", None)])
    login = df(spark, S.LOGIN, [(10, D(2024, 1, 1), "k2", "new@x", "C2", "hd"),
                                (11, D(2024, 1, 2), "k2", "newer@x", "C3", None),
                                (12, D(2024, 1, 1), "k9", "z@x", "Z", None),
                                (13, D(2024, 1, 1), "k1", "q@x", "Q", None)])
    dups = ID.identity_duplicates(ext).collect()
    assert [(r.id_provider, r.n) for r in dups] == [("k1", 2)]
    up = ID.identity_upsert(ext, login)
    rows = {(r.id_provider, r.id_persona): r for r in up.collect()}
    assert rows[("k2", 3)].action == "update" and rows[("k2", 3)].correo == "newer@x"
    assert rows[("k3", 4)].action == "keep"
    assert {r.action for k, r in rows.items() if k[0] == "k1"} == {"duplicate"}
    new = [r for k, r in rows.items() if k[0] == "k9"][0]
    assert new.action == "insert" and new.id_persona is not None
    # upserting the same logins again changes nothing more
    again = ID.identity_upsert(up.drop("action", "login_id"), login)
    assert sorted((r.id_persona, r.correo) for r in again.collect()) == sorted(
        (r.id_persona, r.correo) for r in up.collect())


# ---------------------------------------------------------------- F17
def test_lookup_malformed_owner_misses(spark, dims):
    tickets = df(spark, S.TICKET, [ticket_row(1, colab=1)])
    reqs = df(spark, S.LOOKUP_REQ, [(1, None, 1), (2, 1, 1), (3, 2, 1)])
    cards = lambda t: H.ticket_cards(t, dims["analista"], dims["external"], dims["cliente_servicio"],
                                     dims["servicio"])
    got = {r.req_id: r for r in T.lookup_owned(reqs, tickets, cards).collect()}
    assert not got[1].found and got[1].reply == "No encontré el ticket #1 o no tienes permiso para verlo."
    assert got[2].found and got[2].reply.startswith("He encontrado los detalles del ticket solicitado:\n  - **ID:** #1")
    assert not got[3].found


def test_digest_parts_reassemble(spark, dims):
    tickets = df(spark, S.TICKET, [ticket_row(i, colab=1) for i in (5, 1500, 3)] + [ticket_row(9, colab=2,
                                                                                                estado="finalizado")])
    owners = spark.createDataFrame([(1,), (2,), (3,)], "id_colaborador bigint")
    cards = lambda t: H.ticket_cards(t, dims["analista"], dims["external"], dims["cliente_servicio"],
                                     dims["servicio"])
    parts = T.ticket_digest(owners, tickets, cards).collect()

    def reply(kind, who):
        ps = sorted((p.part, p.text) for p in parts if p.kind == kind and p.id_colaborador == who)
        return "".join(t for _, t in ps)
    card = {r.id_ticket: r.card for r in cards(tickets).collect()}
    assert reply("all", 1) == "He encontrado los siguientes tickets:\n" + "\n\n".join(card[i] for i in (3, 5, 1500))
    assert reply("open", 2) == "Usted no tiene tickets abiertos actualmente."
    assert reply("all", 3) == "Usted no tiene tickets actualmente."


def test_login_issuer_filter(spark):
    ext = df(spark, S.EXTERNAL, [(1, "google", "k1", "a@x", "A", None)])
    login = spark.createDataFrame(
        [(10, D(2024, 1, 1), "k1", "ok@x", "A2", None, "accounts.google.com"),
         (11, D(2024, 1, 2), "k1", "bad@x", "A3", None, "evil.example")],
        "login_id bigint, ts timestamp_ntz, id_provider string, correo string, nombre string, hd string, iss string")
    r = ID.identity_upsert(ext, login).collect()[0]
    assert (r.action, r.correo) == ("update", "ok@x")


def test_upsert_keeps_rows_with_a_null_key(spark):
    ext = df(spark, S.EXTERNAL, [(1, "google", "k1", "a@x", "A", None), (2, None, "k1", "b@x", "B", None),
                                 (3, "google", None, "c@x", "C", None), (4, "google", None, "d@x", "D", None),
                                 (5, "google", "k5", "e@x", "E", None), (6, "google", "k5", "f@x", "F", None)])
    login = df(spark, S.LOGIN, [(10, D(2024, 1, 1), "k1", "new@x", "N", None), (11, D(2024, 1, 1), "k5", "z@x", "Z", None)])
    got = sorted((r.id_persona, r.action, r.correo) for r in ID.identity_upsert(ext, login).collect())
    assert got == [(1, "update", "new@x"), (2, "keep", "b@x"), (3, "keep", "c@x"), (4, "keep", "d@x"),
                   (5, "duplicate", "e@x"), (6, "duplicate", "f@x")]


def test_non_analyst_gets_an_empty_page_whatever_the_status_word(spark, dims):
    reqs = df(spark, S.INBOX_REQ, [(1, 100, "nada", 20, 0), (2, 100, "nada", 0, 0), (3, 1010, "nada", 20, 0)])
    out = I.analyst_inbox(reqs, df(spark, S.TICKET, [ticket_row(1, analyst=10)]), dims["analista"], dims["colaborador"],
                          dims["external"], dims["cliente"], dims["cliente_servicio"], dims["servicio"]).collect()
    assert {r.req_id: (r.code, r.total) for r in out} == {1: (200, 0), 2: (422, None), 3: (400, None)}


def test_empty_results_are_rows(spark):
    from deskpark.operators import services as SV
    msgs = df(spark, S.MENSAJE, [(1, 0, "system", "x"), (2, 0, "user", "hola")])
    assert sorted(map(tuple, TR.transcript_parts(msgs).collect())) == [(1, 0, 0, ""), (2, 0, 1, '{"role":"user","content":"hola"}')]
    parts = SV.service_list_parts(df(spark, S.CLIENTE, [(1, "A"), (2, "B")]), df(spark, S.CLIENTE_SERVICIO, [(5, 2, 9)]),
                                  df(spark, S.SERVICIO, [(9, "Portal")]))
    assert sorted(map(tuple, parts.collect())) == [(1, 0, "Ninguno"), (2, 0, "Portal")]


def test_context_comes_from_the_login(spark, dims):
    from deskpark.operators import services as SV
    login = df(spark, S.LOGIN, [(1, D(2024, 1, 1), "a", "now@x", "Name Now", None), (2, D(2024, 1, 2), "fresh", "f@x", None, None)])
    rows = SV.user_context(login, dims["external"], dims["colaborador"], dims["cliente"], dims["cliente_servicio"],
                           dims["servicio"], "ACME").collect()
    ctx = {(r.login_id, r.kind): r for r in rows}
    assert set(ctx) == {(1, "colaborador"), (1, "analista"), (2, "colaborador"), (2, "analista")}
    parts = sorted((p.part, p.text) for p in SV.service_list_parts(dims["cliente"], dims["cliente_servicio"],
                                                                    dims["servicio"]).where("id_cliente = 1").collect())
    c = ctx[1, "colaborador"]
    assert (c.persona_id, c.colaborador_id, c.cliente_id, c.correo) == ("100", "1", "1", "now@x")
    assert c.context_head + "".join(t for _, t in parts) + c.context_tail == (
        "\n    CONTEXTO DEL USUARIO ACTUAL:\n    - Nombre del usuario: Name Now\n    - Empresa del usuario: ACME"
        "\n    - Servicios contratados por la empresa: Portal, \n    ")
    assert ctx[2, "colaborador"].cliente_id == "1" and ctx[2, "colaborador"].nombre is None
    a = ctx[1, "analista"]
    assert (a.cliente_nombre, a.cliente_id, a.has_services) == ("ANALYTICS", "00000000-0000-0000-0000-000000000000", False)


def test_date_text_ignores_session_time_zone(spark):
    rows = [(D(2024, 3, 10, 2, 30, 5),), (D(2023, 12, 31, 23, 59, 59),), (None,)]
    df_ = spark.createDataFrame(rows, "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 2024-03-10 02:30 is in a DST gap
        got = [(r.d, r.h) for r in df_.select(X.ddmmyyyy("t").alias("d"), X.ddmmyyyy_hms("t").alias("h")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [("10/03/2024", "10/03/2024 02:30:05"), ("31/12/2023", "31/12/2023 23:59:59"), (None, None)]


def test_repeated_search_lists_each_card_once(spark, dims):
    tickets = df(spark, S.TICKET, [ticket_row(1, asunto="Portal caído"), ticket_row(2, asunto="otro")])
    reqs = df(spark, S.SEARCH_REQ, [(1, "portal"), (1, "portal")])
    cards = lambda t: H.ticket_cards(t, dims["analista"], dims["external"], dims["cliente_servicio"],
                                     dims["servicio"])
    parts = T.subject_digest(reqs, tickets, cards).collect()
    assert len([p for p in parts if p.part == -1]) == 1
    body = "".join(p.text for p in sorted(parts, key=lambda p: p.part) if p.part >= 0)
    assert body.count("**ID:** #1") == 1 and "#2" not in body


def test_transcript_parts_reassemble(small):
    whole = {r.id_ticket: r.contenido for r in TR.transcripts(small.mensaje).collect()}
    parts = {}
    for r in TR.transcript_parts(small.mensaje).collect():
        parts.setdefault(r.id_ticket, []).append((r.part, r.fragment))
    rebuilt = {t: "[" + ",".join(f for _, f in sorted(ps)) + "]" for t, ps in parts.items()}
    assert rebuilt == whole


# ---------------------------------------------------------------- T19, T22
def test_null_subject_keeps_its_row(spark, dims):
    tickets = df(spark, S.TICKET, [ticket_row(1, analyst=10, asunto=None), ticket_row(2, analyst=11)])
    reqs = df(spark, S.INBOX_REQ, [(1, 1010, None, 20, 0)])
    page = I.analyst_inbox(reqs, tickets, dims["analista"], dims["colaborador"], dims["external"],
                           dims["cliente"], dims["cliente_servicio"], dims["servicio"]).collect()
    assert [(r.id_ticket, r.subject) for r in page] == [(1, None)]
    det = H.ticket_detail(tickets, dims["colaborador"], dims["external"], dims["cliente"],
                          dims["cliente_servicio"], dims["servicio"], df(spark, S.ESCALADO, []),
                          TR.transcripts(df(spark, S.MENSAJE, []))).collect()
    assert sorted((r.id_ticket, r.subject) for r in det) == [(1, None), (2, "s")]  # unrestricted (T22)
