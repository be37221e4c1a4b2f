"""Set-based command folds equal a slow one-by-one model written here only."""

import hashlib

from deskpark.functions import vocab as V
from deskpark.operators import commands as CM
from deskpark.operators import escalation as ES


def _strip_lower(s):
    return s.lower().strip()


def _analyst_of_person(analysts):
    out = {}
    for a in sorted(analysts, key=lambda a: a.id_analista):
        out.setdefault(a.id_persona, a)
    return out


def test_status_fold_equals_sequential_model(mid):
    tickets = {t.id_ticket: t.asDict() for t in mid.ticket.collect()}
    analysts = _analyst_of_person(mid.analista.collect())
    cmds = sorted(mid.status_cmd.collect(), key=lambda c: (c.ts, c.cmd_id))
    codes = {}
    for c in cmds:
        a = analysts.get(c.id_persona)
        t = tickets.get(c.id_ticket)
        if a is None:
            codes[c.cmd_id] = (403, None)
            continue
        if t is None:
            codes[c.cmd_id] = (404, None)
            continue
        if t["id_analista"] != a.id_analista:
            codes[c.cmd_id] = (403, None)
            continue
        st = V.STATUS_UI_TO_DB.get(_strip_lower(c.status))
        if not st:
            codes[c.cmd_id] = (400, None)
            continue
        t["estado"], t["updated_at"] = st, c.ts
        if st == "finalizado":
            t["closed_at"] = c.ts
            if c.description:
                t["diagnostico"] = c.description[:5000]
        level_code = None
        if c.level:
            lv = V.LEVEL_UI_TO_DB.get(_strip_lower(c.level))
            if not lv:
                level_code = 400
            else:
                t["nivel"], t["updated_at"], level_code = lv, c.ts, 200
        codes[c.cmd_id] = (200, level_code)
    validated = CM.status_validate(mid.status_cmd, mid.analista, mid.ticket)
    got_codes = {r.cmd_id: (r.status_code, r.level_code) for r in validated.collect()}
    assert got_codes == codes
    assert sum(1 for v in codes.values() if v[0] == 200) > 1000
    got = {r.id_ticket: r.asDict() for r in CM.status_apply(mid.ticket, validated).collect()}
    assert got == tickets


def escalation_model(ticket_rows, analyst_rows, cmd_rows):
    """One command after the other, as the reference's endpoint runs them."""
    tickets = {t.id_ticket: t.id_analista for t in ticket_rows}
    analysts = _analyst_of_person(analyst_rows)
    ordered = sorted(analyst_rows, key=lambda a: (-a.nivel, a.id_analista))

    def candidate(cmd_id, level):
        pool = [a for a in ordered if a.nivel > level]
        if not pool:
            return None
        h = int(hashlib.md5(f"{ES.SEED}:{cmd_id}".encode()).hexdigest()[:15], 16)
        return pool[h % len(pool)].id_analista

    codes, moved = {}, {}
    for c in sorted(cmd_rows, key=lambda c: (c.ts, c.cmd_id)):
        a = analysts.get(c.id_persona)
        if c.motivo is None or len(c.motivo) < 10:
            codes[c.cmd_id] = 422
        elif a is None:
            codes[c.cmd_id] = 403
        elif a.nivel >= 3:
            codes[c.cmd_id] = 403
        elif c.id_ticket not in tickets:
            codes[c.cmd_id] = 404
        elif tickets[c.id_ticket] != a.id_analista:
            codes[c.cmd_id] = 403
        else:
            cand = candidate(c.cmd_id, a.nivel)
            if cand is None:
                codes[c.cmd_id] = 409
            else:
                codes[c.cmd_id] = 200
                tickets[c.id_ticket] = cand
                moved[c.id_ticket] = moved.get(c.id_ticket, 0) + 1
    return codes, tickets, moved


def test_escalation_fold_equals_sequential_model(mid):
    codes, tickets, moved = escalation_model(mid.ticket.collect(), mid.analista.collect(),
                                             mid.escalation_cmd.collect())
    validated = ES.escalation_validate(mid.escalation_cmd, mid.analista, mid.ticket)
    assert {r.cmd_id: r.code for r in validated.collect()} == codes
    assert max(moved.values()) == 2  # the data exercises the second round
    got = {r.id_ticket: r.id_analista for r in ES.escalation_apply(mid.ticket, validated).collect()}
    assert got == tickets
    log = ES.escalation_log(mid.escalado, validated).collect()
    start = max(r.id_escalado for r in mid.escalado.collect())
    assert sorted(r.id_escalado for r in log) == list(range(start + 1, start + 1 + sum(moved.values())))


def test_fold_is_independent_of_partitioning(spark, mid):
    a = CM.status_apply(mid.ticket, CM.status_validate(mid.status_cmd.repartition(3), mid.analista, mid.ticket))
    b = CM.status_apply(mid.ticket.repartition(11), CM.status_validate(mid.status_cmd.coalesce(1), mid.analista,
                                                                       mid.ticket))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_escalation_fold_with_more_levels(spark):
    import datetime as dt

    from deskpark.sources import schemas as S
    analysts = spark.createDataFrame([(10, 110, 0), (11, 111, 0), (20, 120, 1), (30, 130, 2), (31, 131, 2),
                                      (40, 140, 3)], S.ANALISTA)
    tickets = spark.createDataFrame([(t, 1, None, 10 + (t % 2), "s", "solicitud", "alto", "aceptado", None,
                                      dt.datetime(2024, 1, 1), None, None) for t in range(1, 7)], S.TICKET)
    cmds, cid = [], 0
    for step in range(5):
        for t in range(1, 7):
            for person in (110, 111, 120, 130, 131, 140):
                cid += 1
                cmds.append((cid, dt.datetime(2024, 2, 1, step), t, person, "necesito ayuda, por favor"))
    cmd_df = spark.createDataFrame(cmds, S.ESCALATION_CMD)
    codes, final, moved = escalation_model(tickets.collect(), analysts.collect(), cmd_df.collect())
    assert max(moved.values()) == 3
    validated = ES.escalation_validate(cmd_df, analysts, tickets)
    assert {r.cmd_id: r.code for r in validated.collect()} == codes
    assert {r.id_ticket: r.id_analista for r in ES.escalation_apply(tickets, validated).collect()} == final


def test_inbox_pages_are_disjoint_and_add_up(spark, mid):
    from pyspark.sql import functions as F

    from deskpark.operators import inbox as I
    from deskpark.sources import schemas as S
    analysts = [r.id_persona for r in mid.analista.orderBy("id_analista").limit(12).collect()]
    reqs, rid = [], 0
    for p in analysts:
        for off in range(0, 400, 7):
            rid += 1
            reqs.append((rid, p, "abierto" if p % 2 else None, 7, off))
    req = spark.createDataFrame(reqs, S.INBOX_REQ)
    out = I.analyst_inbox(req, mid.ticket, mid.analista, mid.colaborador, mid.external, mid.cliente,
                          mid.cliente_servicio, mid.servicio).collect()
    person_of = {r[0]: r[1] for r in reqs}
    seen, totals = {}, {}
    for r in out:
        totals.setdefault(person_of[r.req_id], set()).add(r.total)
        if r.id_ticket is not None:
            seen.setdefault(person_of[r.req_id], []).append(r.id_ticket)
    an = {a.id_persona: a.id_analista for a in mid.analista.collect()}
    for p in analysts:
        t = mid.ticket.where(F.col("id_analista") == an[p])
        if p % 2:
            t = t.where(F.col("estado") == "aceptado")
        want = {r.id_ticket for r in t.select("id_ticket").collect()}
        got = seen.get(p, [])
        assert len(got) == len(set(got)) and set(got) == want and totals[p] == {len(want)}
