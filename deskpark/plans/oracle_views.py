"""DuckDB SQL for every registered query (the correctness oracle).

The fixture views of FIXTURES.md are written once here as CTEs over the
generated tables; ``with_views`` pulls in a view and its dependencies. The
SQL is an independent statement of each operator's semantics, not generated
from the Spark plans.
"""

from __future__ import annotations

from deskpark.functions import text as X
from deskpark.functions import vocab as V

OFF = "1000000000"
STRIP = f"'{X.PY_STRIP_PATTERN}'"


def sql_lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, {STRIP}, '', 'g')"


def map_case(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {expr} {whens} END)"


def status_from_ui(expr: str) -> str:
    return map_case(py_strip(f"lower({expr})"), V.STATUS_UI_TO_DB)


def level_from_ui(expr: str) -> str:
    return map_case(py_strip(f"lower({expr})"), V.LEVEL_UI_TO_DB)


def md5_bigint(*parts: str) -> str:
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def ilike_contains(text: str, q: str) -> str:
    return f"({text} ILIKE '%' || {q} || '%' ESCAPE '\\')"


def target(run: int) -> str:
    """Ticket that an event's command names."""
    return f"(event_id // {run} * 7919 % ((SELECT max(o_orderkey) FROM orders) + 1))"


# name -> (dependencies, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "line1": ((), """
        SELECT l_orderkey, l_partkey, l_suppkey, line_id, shipped FROM (
          SELECT l_orderkey, l_partkey, l_suppkey, (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey AS line_id,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn1,
                 max(l_shipdate) OVER (PARTITION BY l_orderkey) AS shipped
          FROM lineitem) WHERE rn1 = 1"""),
    "ticket": (("line1",), """
        SELECT o_orderkey AS id_ticket, o_custkey AS id_colaborador, line_id AS id_cliente_servicio,
               l_suppkey AS id_analista, p_name AS asunto,
               CASE WHEN o_orderkey % 2 = 0 THEN 'incidencia' ELSE 'solicitud' END AS tipo,
               CASE o_orderpriority WHEN '5-LOW' THEN 'bajo' WHEN '3-MEDIUM' THEN 'medio'
                    WHEN '2-HIGH' THEN 'alto' WHEN '1-URGENT' THEN 'crítico' END AS nivel,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'aceptado'
                    WHEN o_orderstatus = 'F' THEN 'finalizado' WHEN o_orderkey % 5 = 0 THEN 'cancelado'
                    ELSE 'en atención' END AS estado,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 <> 0 THEN 'dx ' || p_name END AS diagnostico,
               o_orderdate AS created_at,
               CASE WHEN o_orderstatus <> 'O' THEN shipped END AS updated_at,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 THEN shipped END AS closed_at
        FROM orders LEFT JOIN line1 ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey"""),
    "cliente": ((), "SELECT CAST(n_nationkey AS BIGINT) AS id_cliente, n_name AS nombre FROM nation"),
    "colaborador": ((), """
        SELECT c_custkey AS id_colaborador, c_custkey AS id_persona, CAST(c_nationkey AS BIGINT) AS id_cliente
        FROM customer"""),
    "analista": ((), f"""
        SELECT s_suppkey AS id_analista, {OFF} + s_suppkey AS id_persona,
               CAST(CASE s_suppkey % 50 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS INTEGER) AS nivel
        FROM supplier"""),
    "external": ((), f"""
        SELECT c_custkey AS id_persona, 'google' AS provider, CAST(c_custkey AS VARCHAR) AS id_provider,
               lower(c_name) || '@example.test' AS correo, c_name AS nombre, CAST(NULL AS VARCHAR) AS hd
        FROM customer WHERE c_custkey % 13 <> 0
        UNION ALL
        SELECT c_custkey, 'google', 'z' || CAST(c_custkey AS VARCHAR), 'alt@example.test', 'Alt ' || c_name,
               CAST(NULL AS VARCHAR)
        FROM customer WHERE c_custkey % 17 = 1
        UNION ALL
        SELECT 2 * {OFF} + c_custkey, 'google', CAST(c_custkey AS VARCHAR), 'dup@example.test', 'Dup ' || c_name,
               CAST(NULL AS VARCHAR)
        FROM customer WHERE c_custkey % 97 = 5
        UNION ALL
        SELECT {OFF} + s_suppkey, 'google', 's' || CAST(s_suppkey AS VARCHAR),
               lower(s_name) || '@example.test', s_name, CAST(NULL AS VARCHAR)
        FROM supplier"""),
    "servicio": ((), "SELECT p_partkey AS id_servicio, p_name AS nombre FROM part"),
    "cliente_servicio": ((), """
        SELECT DISTINCT (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey AS id_cliente_servicio, CAST(c_nationkey AS BIGINT) AS id_cliente,
               l_partkey AS id_servicio
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""),
    "escalado": ((), """
        SELECT event_id AS id_escalado, user_id AS id_ticket, user_id % 10 AS id_analista_solicitante,
               (user_id + 1) % 10 AS id_analista_derivado, props AS motivo
        FROM events WHERE event_type = 'error'"""),
    "mensaje": ((), """
        SELECT conv_id AS id_ticket, turn, role, text AS content FROM conversations
        UNION ALL
        SELECT conv_id + (SELECT max(conv_id) + 1 FROM conversations), turn, 'system', text
        FROM conversations WHERE conv_id % 20 = 7"""),
    "kb_document": ((), "SELECT doc_id, text FROM documents"),
    "kb_question": ((), """
        SELECT conv_id, turn, text AS q FROM conversations WHERE role = 'user'
        UNION ALL
        SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), 'xqz' || conv_id
        FROM conversations WHERE role = 'user' AND conv_id % 25 = 3"""),
    "search_req": ((), """
        SELECT c_custkey AS id_colaborador,
               CASE c_custkey % 5 WHEN 0 THEN 'RED' WHEN 1 THEN 'bolt' WHEN 2 THEN '%e_r' WHEN 3 THEN ''
                    ELSE 'zzz' END AS q
        FROM customer"""),
    "owner_req": (("search_req",), "SELECT id_colaborador FROM search_req"),
    "lookup_req": ((), """
        SELECT o_orderkey AS req_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS id_colaborador,
               CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS id_ticket
        FROM orders"""),
    "inbox_req": ((), f"""
        SELECT s_suppkey AS req_id,
               CASE WHEN s_suppkey % 9 = 4 THEN s_suppkey ELSE s_suppkey + {OFF} END AS id_persona,
               CASE s_suppkey % 7 WHEN 1 THEN 'Todos' WHEN 2 THEN 'Abierto' WHEN 3 THEN ' Cerrado '
                    WHEN 4 THEN 'nada' WHEN 5 THEN '' WHEN 6 THEN ' todos ' END AS status,
               CAST(CASE WHEN s_suppkey % 31 = 8 THEN 0 WHEN s_suppkey % 31 = 9 THEN 101 WHEN s_suppkey % 31 = 10 THEN NULL
                    ELSE CASE s_suppkey % 3 WHEN 0 THEN 20 WHEN 1 THEN 5 ELSE 100 END END AS INTEGER) AS page_limit,
               CAST(CASE WHEN s_suppkey % 31 = 11 THEN -1 WHEN s_suppkey % 31 = 12 THEN NULL
                    ELSE CASE s_suppkey % 4 WHEN 1 THEN 5 WHEN 2 THEN 40 ELSE 0 END END AS INTEGER) AS page_offset
        FROM supplier"""),
    "intake_req": ((), """
        SELECT c_custkey AS req_id, c_custkey AS id_colaborador, CAST(c_nationkey AS BIGINT) AS id_cliente,
               CASE c_custkey % 4 WHEN 0 THEN 'WIDGET' WHEN 1 THEN 'red' WHEN 2 THEN 'ring' ELSE 'nada' END
                 AS nombre_servicio,
               CASE WHEN c_custkey % 33 = 4 THEN 'queja' WHEN c_custkey % 20 = 0 THEN 'incidencia'
                    ELSE 'solicitud' END AS tipo,
               CASE WHEN c_custkey % 35 = 6 THEN NULL WHEN c_custkey % 35 = 7 THEN 'urgente' ELSE 'alto' END AS nivel, 'Solicitud de ' || c_name AS asunto,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS ts, c_custkey AS thread_id
        FROM customer"""),
    "login": ((), """
        SELECT event_id AS login_id, ts, CAST(user_id AS VARCHAR) AS id_provider,
               'u' || CAST(event_id AS VARCHAR) || '@example.test' AS correo,
               'Login ' || CAST(event_id AS VARCHAR) AS nombre,
               CASE WHEN event_id % 2 = 0 THEN 'example.test' END AS hd
        FROM events WHERE event_type = 'purchase'"""),
    "status_cmd": (("line1",), f"""
        SELECT event_id AS cmd_id, ts,
               {target(4)} + CASE WHEN event_id % 97 = 0 THEN {OFF} ELSE 0 END AS id_ticket,
               CASE WHEN event_id % 23 = 0 THEN user_id WHEN event_id % 4 = 0 THEN {OFF} + user_id % 10
                    ELSE coalesce({OFF} + l_suppkey, {OFF}) END AS id_persona,
               CASE event_id % 9 WHEN 0 THEN 'Abierto' WHEN 1 THEN ' En Atención ' WHEN 2 THEN 'en atencion'
                    WHEN 3 THEN 'CERRADO' WHEN 4 THEN 'finalizado' WHEN 5 THEN 'Cancelado'
                    WHEN 6 THEN 'rechazado' WHEN 7 THEN 'perdido' ELSE chr(9) || 'abierto' END AS status,
               CASE event_id % 7 WHEN 0 THEN 'Alto' WHEN 1 THEN 'critico' WHEN 2 THEN 'urgente'
                    WHEN 3 THEN ' Medio ' WHEN 4 THEN '' END AS level,
               CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 < 3 THEN props END AS description
        FROM events LEFT JOIN line1 ON l_orderkey = {target(4)}
        WHERE event_type IN ('click', 'view')"""),
    "escalation_cmd": (("line1",), f"""
        SELECT event_id AS cmd_id, ts,
               {target(32)} + CASE WHEN event_id % 97 = 0 THEN {OFF} ELSE 0 END AS id_ticket,
               CASE WHEN event_id % 23 = 0 THEN user_id WHEN event_id % 3 = 0 THEN {OFF} + 1
                    WHEN event_id % 3 = 1 THEN {OFF} + 51
                    ELSE coalesce({OFF} + l_suppkey, {OFF}) END AS id_persona,
               CASE WHEN event_id % 19 = 0 THEN 'corto' ELSE 'motivo de derivacion ' || props END AS motivo
        FROM events LEFT JOIN line1 ON l_orderkey = {target(32)}
        WHERE event_type = 'signup'"""),
    # ---- shared lookups (hydration)
    "first_ext": (("external",), """
        SELECT id_persona, nombre AS ext_nombre, correo AS ext_correo FROM (
          SELECT *, row_number() OVER (PARTITION BY id_persona ORDER BY provider, id_provider, nombre, correo) AS r
          FROM external) WHERE r = 1"""),
    "prof": (("colaborador", "first_ext", "cliente"), """
        SELECT c.id_colaborador, e.ext_nombre AS "user", e.ext_correo AS email, cl.company
        FROM (SELECT id_colaborador, id_persona, id_cliente FROM (
                SELECT *, row_number() OVER (PARTITION BY id_colaborador ORDER BY id_persona, id_cliente) AS r
                FROM colaborador) WHERE r = 1) c
        LEFT JOIN first_ext e ON e.id_persona = c.id_persona
        LEFT JOIN (SELECT id_cliente, min(nombre) AS company FROM cliente GROUP BY id_cliente) cl
               ON cl.id_cliente = c.id_cliente"""),
    "svc": (("cliente_servicio", "servicio"), """
        SELECT cs.id_cliente_servicio, s.service, s.has_service
        FROM (SELECT id_cliente_servicio, min(id_servicio) AS id_servicio FROM cliente_servicio GROUP BY 1) cs
        LEFT JOIN (SELECT id_servicio, min(nombre) AS service, true AS has_service FROM servicio GROUP BY 1) s
               ON s.id_servicio = cs.id_servicio"""),
    "analyst_names": (("analista", "first_ext"), """
        SELECT a.id_analista, e.ext_nombre AS analyst_name, e.id_persona IS NOT NULL AS has_name
        FROM (SELECT id_analista, min(id_persona) AS id_persona FROM analista GROUP BY 1) a
        LEFT JOIN first_ext e ON e.id_persona = a.id_persona"""),
    "analyst_of_person": (("analista",), """
        SELECT id_persona, id_analista, nivel AS analyst_level FROM (
          SELECT *, row_number() OVER (PARTITION BY id_persona ORDER BY id_analista, nivel) AS r FROM analista)
        WHERE r = 1"""),
    "latest_esc": (("escalado",), """
        SELECT id_ticket, motivo AS escalation_reason FROM (
          SELECT *, row_number() OVER (PARTITION BY id_ticket ORDER BY id_escalado DESC) AS r FROM escalado)
        WHERE r = 1"""),
    "conv_json": (("mensaje",), """
        SELECT id_ticket,
               count(*) FILTER (WHERE role IN ('user', 'assistant')) AS n_messages,
               CASE WHEN count(*) FILTER (WHERE role IN ('user', 'assistant')) = 0 THEN '[]'
                    ELSE to_json(list({'role': CASE role WHEN 'user' THEN 'user' ELSE 'agent' END,
                                       'content': content} ORDER BY turn)
                                 FILTER (WHERE role IN ('user', 'assistant')))::VARCHAR END AS contenido
        FROM mensaje GROUP BY id_ticket"""),
    "cards": (("ticket", "analyst_names", "svc"), f"""
        SELECT t.id_ticket, t.id_colaborador, t.estado,
               '  - **ID:** #' || CAST(t.id_ticket AS VARCHAR)
               || '\n  - **Asunto:** ' || coalesce(t.asunto, 'None')
               || '\n  - **Servicio:** ' || CASE WHEN s.has_service THEN coalesce(s.service, 'None')
                                                ELSE '{V.CARD_NO_SERVICE}' END
               || '\n  - **Nivel:** ' || coalesce(t.nivel, 'None')
               || '\n  - **Tipo:** ' || coalesce(t.tipo, 'None')
               || '\n  - **Estado:** ' || coalesce(t.estado, 'None')
               || '  - **Analista:** ' || CASE WHEN n.has_name THEN coalesce(n.analyst_name, 'None')
                                              ELSE '{V.CARD_NO_ANALYST}' END
               || '  - **Fecha de Creación:** ' || coalesce(strftime(t.created_at, '%d/%m/%Y'), '-')
               || CASE WHEN t.estado = 'finalizado' AND length(t.diagnostico) > 0
                       THEN '\n  - **Diagnóstico:** ' || t.diagnostico ELSE '' END AS card
        FROM ticket t
        LEFT JOIN analyst_names n ON n.id_analista = t.id_analista
        LEFT JOIN svc s ON s.id_cliente_servicio = t.id_cliente_servicio"""),
    "upsert": (("external", "login"), f"""
        WITH dup AS (SELECT provider, id_provider, count(*) AS _n FROM external GROUP BY 1, 2),
        ext AS (SELECT e.*, d._n FROM external e JOIN dup d ON d.provider = e.provider
                                                          AND d.id_provider = e.id_provider),
        new AS (SELECT 'google' AS provider, id_provider, login_id, correo AS l_correo, nombre AS l_nombre,
                       hd AS l_hd FROM (
                  SELECT *, row_number() OVER (PARTITION BY id_provider ORDER BY ts DESC, login_id DESC) AS r
                  FROM login) WHERE r = 1),
        j AS (SELECT coalesce(ext.provider, new.provider) AS provider,
                     coalesce(ext.id_provider, new.id_provider) AS id_provider,
                     ext.id_persona, ext.correo, ext.nombre, ext.hd, ext._n, new.login_id, new.l_correo,
                     new.l_nombre, new.l_hd, ext.provider IS NOT NULL AS has_ext
              FROM ext FULL OUTER JOIN new ON ext.provider = new.provider AND ext.id_provider = new.id_provider),
        k AS (SELECT *, CASE WHEN NOT has_ext THEN 'insert' WHEN login_id IS NULL THEN 'keep'
                             WHEN _n > 1 THEN 'duplicate' ELSE 'update' END AS action FROM j)
        SELECT coalesce(id_persona, {md5_bigint('provider', 'id_provider')}) AS id_persona, provider, id_provider,
               CASE WHEN action IN ('insert', 'update') THEN l_correo ELSE correo END AS correo,
               CASE WHEN action IN ('insert', 'update') THEN l_nombre ELSE nombre END AS nombre,
               CASE WHEN action IN ('insert', 'update') THEN l_hd ELSE hd END AS hd,
               action, login_id
        FROM k"""),
    "status_valid": (("status_cmd", "analyst_of_person", "ticket"), f"""
        WITH j AS (
          SELECT c.*, a.id_analista, t.id_analista AS assignee, t.id_ticket IS NOT NULL AS has_t,
                 {status_from_ui('c.status')} AS db_status, {level_from_ui('c.level')} AS db_level
          FROM status_cmd c LEFT JOIN analyst_of_person a ON a.id_persona = c.id_persona
          LEFT JOIN ticket t ON t.id_ticket = c.id_ticket),
        k AS (SELECT *, CASE WHEN id_analista IS NULL THEN 403 WHEN NOT has_t THEN 404
                             WHEN assignee IS DISTINCT FROM id_analista THEN 403
                             WHEN db_status IS NULL THEN 400 ELSE 200 END AS status_code FROM j)
        SELECT cmd_id, ts, id_ticket, id_analista, status_code,
               CASE WHEN status_code <> 200 THEN NULL WHEN level IS NULL OR level = '' THEN NULL
                    WHEN db_level IS NULL THEN 400 ELSE 200 END AS level_code,
               db_status, db_level, description
        FROM k"""),
    "esc_off": (("analista",), """
        SELECT nivel, n_level,
               CAST(coalesce(sum(n_level) OVER (ORDER BY nivel DESC ROWS BETWEEN UNBOUNDED PRECEDING
                                                AND 1 PRECEDING), 0) AS BIGINT) AS n_above
        FROM (SELECT nivel, count(*) AS n_level FROM analista GROUP BY 1)"""),
    "esc_pos": (("analista", "esc_off"), """
        SELECT a.id_analista,
               CAST(o.n_above + row_number() OVER (PARTITION BY a.nivel ORDER BY a.id_analista) - 1 AS BIGINT) AS pos
        FROM analista a JOIN esc_off o ON o.nivel = a.nivel"""),
    "esc_valid": (("escalation_cmd", "analyst_of_person", "ticket", "esc_off", "esc_pos"), f"""
        WITH j AS (
          SELECT c.*, a.id_analista AS issuer, a.analyst_level AS issuer_level, t.id_analista AS a0,
                 t.id_ticket IS NOT NULL AS has_t
          FROM escalation_cmd c LEFT JOIN analyst_of_person a ON a.id_persona = c.id_persona
          LEFT JOIN ticket t ON t.id_ticket = c.id_ticket),
        k AS (SELECT *, CASE WHEN motivo IS NULL OR length(motivo) < 10 THEN 422 WHEN issuer IS NULL THEN 403
                             WHEN issuer_level >= 3 THEN 403 WHEN NOT has_t THEN 404 END AS static_code FROM j),
        ok AS (
          SELECT k.cmd_id, k.ts, k.id_ticket, k.issuer, k.a0, p.id_analista AS cand
          FROM k LEFT JOIN esc_off o ON o.nivel = k.issuer_level
          LEFT JOIN esc_pos p ON o.n_above > 0 AND p.pos = {md5_bigint('7', 'k.cmd_id')} % nullif(o.n_above, 0)
          WHERE k.static_code IS NULL),
        r1 AS (
          SELECT id_ticket, ts AS t1, cmd_id AS c1, cand AS a1 FROM (
            SELECT *, row_number() OVER (PARTITION BY id_ticket ORDER BY ts, cmd_id) AS r
            FROM ok WHERE issuer = a0 AND cand IS NOT NULL) WHERE r = 1),
        r2 AS (
          SELECT id_ticket, ts AS t2, cmd_id AS c2, cand AS a2 FROM (
            SELECT ok.*, row_number() OVER (PARTITION BY ok.id_ticket ORDER BY ok.ts, ok.cmd_id) AS r
            FROM ok JOIN r1 ON r1.id_ticket = ok.id_ticket
            WHERE (ok.ts > r1.t1 OR (ok.ts = r1.t1 AND ok.cmd_id > r1.c1)) AND ok.issuer = r1.a1
              AND ok.cand IS NOT NULL) WHERE r = 1),
        judged AS (
          SELECT ok.cmd_id, ok.cand, ok.issuer,
                 CASE WHEN r2.t2 IS NOT NULL AND (r2.t2 < ok.ts OR (r2.t2 = ok.ts AND r2.c2 < ok.cmd_id)) THEN r2.a2
                      WHEN r1.t1 IS NOT NULL AND (r1.t1 < ok.ts OR (r1.t1 = ok.ts AND r1.c1 < ok.cmd_id)) THEN r1.a1
                      ELSE ok.a0 END AS assignee_then
          FROM ok LEFT JOIN r1 ON r1.id_ticket = ok.id_ticket LEFT JOIN r2 ON r2.id_ticket = ok.id_ticket),
        dyn AS (SELECT cmd_id, cand, CASE WHEN issuer IS DISTINCT FROM assignee_then THEN 403
                                          WHEN cand IS NULL THEN 409 ELSE 200 END AS dyn_code FROM judged)
        SELECT k.cmd_id, k.ts, k.id_ticket, coalesce(k.static_code, d.dyn_code) AS code,
               k.issuer AS id_analista_solicitante,
               CASE WHEN coalesce(k.static_code, d.dyn_code) = 200 THEN d.cand END AS id_analista_derivado, k.motivo
        FROM k LEFT JOIN dyn d ON d.cmd_id = k.cmd_id"""),
    "service_hits": (("intake_req", "cliente_servicio", "servicio"), f"""
        WITH named AS (
          SELECT cs.id_cliente, s.nombre, min(cs.id_cliente_servicio) AS first_cs
          FROM cliente_servicio cs JOIN servicio s ON s.id_servicio = cs.id_servicio GROUP BY 1, 2)
        SELECT r.req_id, min(n.first_cs) AS id_cliente_servicio
        FROM intake_req r JOIN named n ON n.id_cliente = r.id_cliente
        WHERE {ilike_contains('n.nombre', 'r.nombre_servicio')} GROUP BY 1"""),
}


def with_views(body: str, *names: str) -> str:
    """``WITH <views needed, dependencies first> <body>``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = VIEWS[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
