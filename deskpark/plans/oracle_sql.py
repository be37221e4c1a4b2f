"""Oracle SQL per registered query (DuckDB dialect, fixture views inlined)."""

from __future__ import annotations

from deskpark.functions import vocab as V
from deskpark.plans.oracle_views import (
    ilike_contains, level_from_ui, md5_bigint, sql_lit, status_from_ui, with_views,
)

ORACLE: dict[str, str] = {}


def q(name: str, *views: str):
    def deco(fn):
        ORACLE[name] = with_views(fn(), *views)
        return fn
    return deco


@q("analyst_inbox", "inbox_req", "analyst_of_person", "ticket", "prof", "svc")
def _inbox() -> str:
    return f"""
    WITH req AS (
      SELECT r.req_id, a.id_analista, CAST(coalesce(r.page_limit, {V.PAGE_LIMIT_DEFAULT}) AS INTEGER) AS page_limit,
             CAST(coalesce(r.page_offset, 0) AS INTEGER) AS page_offset,
             (r.status IS NULL OR r.status = '' OR lower(r.status) = '{V.FILTER_ALL}') AS no_filter,
             {status_from_ui('r.status')} AS mapped
      FROM inbox_req r LEFT JOIN analyst_of_person a ON a.id_persona = r.id_persona),
    req2 AS (
      SELECT *, CASE WHEN page_limit < 1 OR page_limit > {V.PAGE_LIMIT_MAX} OR page_offset < 0 THEN 422
                     WHEN id_analista IS NULL THEN 200 WHEN NOT no_filter AND mapped IS NULL THEN 400 ELSE 200 END AS code
      FROM req),
    matched AS (
      SELECT r.req_id, r.page_offset, r.page_limit, t.*
      FROM ticket t JOIN req2 r ON t.id_analista = r.id_analista
      WHERE r.code = 200 AND (r.no_filter OR t.estado = r.mapped)),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY updated_at DESC NULLS FIRST, id_ticket DESC) AS rk
      FROM matched),
    totals AS (SELECT req_id, count(*) AS total FROM matched GROUP BY req_id),
    page AS (SELECT * FROM ranked WHERE rk > page_offset AND rk <= page_offset + page_limit)
    SELECT r.req_id, r.code,
           CAST(CASE WHEN r.code <> 200 THEN NULL ELSE coalesce(tt.total, 0) END AS BIGINT) AS total,
           r.page_limit, r.page_offset, CAST(p.rk - p.page_offset AS INTEGER) AS rn, p.id_ticket,
           p.asunto AS subject, pr."user" AS "user", nullif(s.service, '') AS service, p.estado AS status,
           strftime(p.created_at, '%d/%m/%Y') AS date, p.updated_at
    FROM req2 r
    LEFT JOIN totals tt ON tt.req_id = r.req_id
    LEFT JOIN page p ON p.req_id = r.req_id
    LEFT JOIN prof pr ON pr.id_colaborador = p.id_colaborador
    LEFT JOIN svc s ON s.id_cliente_servicio = p.id_cliente_servicio
    """


@q("ticket_hydrate", "ticket", "prof", "svc")
def _hydrate() -> str:
    return """
    SELECT t.id_ticket, t.asunto AS subject, t.estado AS status, t.tipo AS type,
           strftime(t.created_at, '%d/%m/%Y') AS date, t.updated_at, p."user" AS "user", p.email, p.company,
           nullif(s.service, '') AS service
    FROM ticket t
    LEFT JOIN prof p ON p.id_colaborador = t.id_colaborador
    LEFT JOIN svc s ON s.id_cliente_servicio = t.id_cliente_servicio
    """


@q("latest_escalation", "latest_esc")
def _latest_esc() -> str:
    return "SELECT id_ticket, escalation_reason FROM latest_esc"


@q("transcripts", "conv_json")
def _transcripts() -> str:
    return "SELECT id_ticket, CAST(n_messages AS INTEGER) AS n_messages, contenido FROM conv_json"


@q("transcript_parts", "mensaje")
def _transcript_parts() -> str:
    return """
    SELECT id_ticket, CAST(turn // 1000 AS BIGINT) AS part, count(*) AS n_messages,
           string_agg(to_json({'role': CASE role WHEN 'user' THEN 'user' ELSE 'agent' END,
                               'content': content})::VARCHAR, ',' ORDER BY turn) AS fragment
    FROM mensaje WHERE role IN ('user', 'assistant') GROUP BY 1, 2
    UNION ALL
    SELECT id_ticket, 0, 0, '' FROM mensaje GROUP BY id_ticket
    HAVING count(*) FILTER (WHERE role IN ('user', 'assistant')) = 0"""


@q("ticket_detail", "ticket", "prof", "svc", "latest_esc", "conv_json")
def _detail() -> str:
    return """
    SELECT t.id_ticket, t.asunto AS subject, t.tipo AS type, p."user" AS "user", p.company, s.service, p.email,
           strftime(t.created_at, '%d/%m/%Y') AS date, t.estado AS status,
           coalesce(c.contenido, '[]') AS conversation, t.updated_at, t.nivel AS level,
           t.diagnostico AS description, nullif(e.escalation_reason, '') AS escalation_reason
    FROM ticket t
    LEFT JOIN prof p ON p.id_colaborador = t.id_colaborador
    LEFT JOIN svc s ON s.id_cliente_servicio = t.id_cliente_servicio
    LEFT JOIN latest_esc e ON e.id_ticket = t.id_ticket
    LEFT JOIN conv_json c ON c.id_ticket = t.id_ticket
    """


@q("ticket_cards", "cards")
def _cards() -> str:
    return "SELECT id_ticket, id_colaborador, estado, card FROM cards"


TICKET_COLS = "id_colaborador, id_ticket, asunto, nivel, tipo, estado, created_at"
OWNED = "(SELECT * FROM ticket WHERE id_colaborador IN (SELECT id_colaborador FROM owner_req))"


@q("open_tickets", "ticket", "owner_req")
def _open() -> str:
    return f"SELECT {TICKET_COLS} FROM {OWNED} WHERE estado <> 'finalizado'"


@q("all_tickets", "ticket", "owner_req")
def _all() -> str:
    return f"SELECT {TICKET_COLS} FROM {OWNED}"


@q("ticket_lookup_owned", "lookup_req", "ticket", "cards")
def _lookup() -> str:
    found, missing = V.REPLY_ONE_FOUND, V.REPLY_ONE_MISSING.split("{id}")
    return f"""
    SELECT r.req_id, r.id_ticket, c.card IS NOT NULL AS found,
           CASE WHEN c.card IS NOT NULL THEN '{found}' || c.card
                ELSE '{missing[0]}' || CAST(r.id_ticket AS VARCHAR) || '{missing[1]}' END AS reply
    FROM lookup_req r LEFT JOIN cards c ON c.id_ticket = r.id_ticket AND c.id_colaborador = r.id_colaborador
    """


SUBJECT_HITS = f"""
    SELECT r.id_colaborador, r.q, t.id_ticket, t.asunto
    FROM search_req r JOIN ticket t ON t.id_colaborador = r.id_colaborador
    WHERE {ilike_contains('t.asunto', 'r.q')}"""


@q("tickets_by_subject", "search_req", "ticket")
def _subject() -> str:
    return SUBJECT_HITS


def _parts(keys: str, cards_sql: str, req_sql: str, found: str, empty: str, extra_cols: str = "") -> str:
    """Reply parts: header row (part -1) + one row per id_ticket // 1000 block."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"f.{c} = x.{c}" for c in k)
    return f"""
    cards_k AS ({cards_sql}),
    firsts AS (SELECT {keys}, min(id_ticket) AS f FROM cards_k GROUP BY {keys}),
    body AS (
      SELECT {', '.join('x.' + c for c in k)}, CAST(x.id_ticket // 1000 AS BIGINT) AS part,
             string_agg(CASE WHEN x.id_ticket = f.f THEN chr(10) ELSE chr(10) || chr(10) END || x.card, ''
                        ORDER BY x.id_ticket) AS text
      FROM cards_k x JOIN firsts f ON {on}
      GROUP BY {', '.join('x.' + c for c in k)}, x.id_ticket // 1000),
    head AS (
      SELECT {', '.join('x.' + c for c in k)}, CAST(-1 AS BIGINT) AS part,
             CASE WHEN f.f IS NULL THEN {empty} ELSE {found} END AS text
      FROM ({req_sql}) x LEFT JOIN firsts f ON {on})
    SELECT {extra_cols}{keys}, part, text FROM head UNION ALL SELECT {extra_cols}{keys}, part, text FROM body"""


@q("subject_digest", "search_req", "ticket", "cards")
def _subject_digest() -> str:
    f0, f1 = V.REPLY_SUBJECT_FOUND.split("{q}")
    e0, e1 = V.REPLY_SUBJECT_EMPTY.split("{q}")
    cards_sql = f"SELECT h.id_colaborador, h.q, h.id_ticket, c.card FROM ({SUBJECT_HITS}) h " \
                "JOIN cards c ON c.id_ticket = h.id_ticket"
    return "WITH " + _parts("id_colaborador, q", cards_sql, "SELECT id_colaborador, q FROM search_req",
                            f"{sql_lit(f0)} || x.q || {sql_lit(f1)}", f"{sql_lit(e0)} || x.q || {sql_lit(e1)}")


@q("ticket_digest", "owner_req", "ticket", "cards")
def _digest() -> str:
    out = []
    for kind, where, found, empty in (("open", "WHERE estado <> 'finalizado'", V.REPLY_OPEN_FOUND,
                                       V.REPLY_OPEN_EMPTY),
                                      ("all", "", V.REPLY_ALL_FOUND, V.REPLY_ALL_EMPTY)):
        cards_sql = f"SELECT c.id_colaborador, c.id_ticket, c.card FROM cards c " \
                    f"WHERE c.id_ticket IN (SELECT id_ticket FROM {OWNED} {where})"
        inner = "WITH " + _parts("id_colaborador", cards_sql, "SELECT id_colaborador FROM owner_req",
                                 f"'{found}'", f"'{empty}'", extra_cols=f"'{kind}' AS kind, ")
        out.append(f"SELECT * FROM ({inner})")
    return " UNION ALL ".join(out)


@q("recent_tickets", "ticket", "owner_req")
def _recent() -> str:
    return f"""
    SELECT id_colaborador, CAST(rn AS INTEGER) AS rn, id_ticket, asunto, nivel, estado, created_at FROM (
      SELECT *, row_number() OVER (PARTITION BY id_colaborador
                                   ORDER BY created_at DESC NULLS LAST, id_ticket DESC) AS rn
      FROM {OWNED}) WHERE rn <= {V.RECENT_TICKETS}"""


@q("urgency_summary", "ticket", "owner_req")
def _urgency() -> str:
    return f"""
    SELECT r.id_colaborador, coalesce(a.n_open, 0) AS n_open, coalesce(a.n_bajo, 0) AS n_bajo,
           coalesce(a.n_medio, 0) AS n_medio, coalesce(a.n_alto, 0) AS n_alto,
           coalesce(a.n_critico, 0) AS n_critico
    FROM owner_req r LEFT JOIN (
      SELECT id_colaborador, count(*) AS n_open,
             count(*) FILTER (WHERE nivel = 'bajo') AS n_bajo, count(*) FILTER (WHERE nivel = 'medio') AS n_medio,
             count(*) FILTER (WHERE nivel = 'alto') AS n_alto, count(*) FILTER (WHERE nivel = 'crítico') AS n_critico
      FROM {OWNED} WHERE estado <> 'finalizado' GROUP BY id_colaborador) a ON a.id_colaborador = r.id_colaborador"""


@q("sla_due", "ticket")
def _sla() -> str:
    cases = " ".join(f"WHEN '{lv}' THEN created_at + INTERVAL {d} DAY + INTERVAL {h} HOUR"
                     for lv, (d, h) in V.SLA_BY_LEVEL.items())
    return f"SELECT id_ticket, nivel, created_at, CASE nivel {cases} END AS due_at FROM ticket"


@q("client_services", "cliente_servicio", "servicio")
def _client_services() -> str:
    return """
    SELECT cs.id_cliente, CAST(s.id_servicio AS VARCHAR) AS id_servicio, s.nombre
    FROM (SELECT DISTINCT id_cliente, id_servicio FROM cliente_servicio) cs
    JOIN servicio s ON s.id_servicio = cs.id_servicio"""


@q("service_resolve", "intake_req", "cliente_servicio", "servicio")
def _service_resolve() -> str:
    return f"""
    WITH named AS (
      SELECT cs.id_cliente, s.nombre, min(cs.id_cliente_servicio) AS first_cs
      FROM cliente_servicio cs JOIN servicio s ON s.id_servicio = cs.id_servicio GROUP BY 1, 2),
    hits AS (
      SELECT r.req_id, min(n.first_cs) AS id_cliente_servicio
      FROM intake_req r JOIN named n ON n.id_cliente = r.id_cliente
      WHERE {ilike_contains('n.nombre', 'r.nombre_servicio')} GROUP BY 1)
    SELECT r.req_id, h.id_cliente_servicio FROM intake_req r LEFT JOIN hits h ON h.req_id = r.req_id"""


def _context_head(nombre: str, cliente: str) -> str:
    from deskpark.operators.services import CONTEXT_HEAD
    a, rest = CONTEXT_HEAD.split("{nombre}")
    b, c = rest.split("{cliente}")
    return (f"{sql_lit(a)} || coalesce({nombre}, 'None') || {sql_lit(b)} || coalesce({cliente}, 'None') || "
            f"{sql_lit(c)}")


@q("service_list_parts", "cliente", "cliente_servicio", "servicio")
def _service_list_parts() -> str:
    return """
    WITH named AS (SELECT p.id_cliente, s.id_servicio, s.nombre
                   FROM (SELECT DISTINCT id_cliente, id_servicio FROM cliente_servicio) p
                   JOIN servicio s ON s.id_servicio = p.id_servicio WHERE s.nombre IS NOT NULL),
    firsts AS (SELECT id_cliente, min(id_servicio) AS f FROM named GROUP BY 1)
    SELECT n.id_cliente, CAST(n.id_servicio // 1000 AS BIGINT) AS part,
           string_agg(CASE WHEN n.id_servicio = f.f THEN '' ELSE ', ' END || n.nombre, '' ORDER BY n.id_servicio)
             AS text
    FROM named n JOIN firsts f ON f.id_cliente = n.id_cliente
    GROUP BY n.id_cliente, n.id_servicio // 1000
    UNION ALL
    SELECT DISTINCT id_cliente, 0, 'Ninguno' FROM cliente WHERE id_cliente NOT IN (SELECT id_cliente FROM named)"""


@q("identity_upsert", "upsert")
def _upsert() -> str:
    return "SELECT * FROM upsert"


@q("identity_duplicates", "external")
def _dups() -> str:
    return "SELECT provider, id_provider, count(*) AS n FROM external GROUP BY 1, 2 HAVING count(*) > 1"


PERSONAS = "(SELECT DISTINCT id_persona FROM upsert WHERE action IN ('insert', 'update'))"


@q("role_collaborator", "upsert", "colaborador", "cliente")
def _role_collab() -> str:
    from deskpark.sources.fixtures import DEFAULT_CLIENT
    client = f"(SELECT min(id_cliente) FROM cliente WHERE nombre = {sql_lit(DEFAULT_CLIENT)})"
    return f"""
    WITH existing AS (SELECT id_persona, min(id_colaborador) AS old_id FROM colaborador
                      WHERE id_cliente = {client} GROUP BY 1)
    SELECT p.id_persona, CAST({client} AS BIGINT) AS id_cliente,
           coalesce(e.old_id, {md5_bigint("'colaborador'", 'p.id_persona', client)}) AS id_colaborador,
           CASE WHEN e.old_id IS NULL THEN 'created' ELSE 'existing' END AS action
    FROM {PERSONAS} p LEFT JOIN existing e ON e.id_persona = p.id_persona"""


@q("user_context", "upsert", "login", "colaborador", "cliente", "cliente_servicio", "servicio")
def _user_context() -> str:
    from deskpark.operators.services import CONTEXT_TAIL
    cli_name = f"coalesce(cl.cli_nombre, {sql_lit(V.UNKNOWN_CLIENT)})"
    return f"""
    WITH role AS ({_role_collab()}),
    who AS (SELECT l.login_id, u.id_persona, l.nombre, l.correo
            FROM login l JOIN upsert u ON u.provider = 'google' AND u.id_provider = l.id_provider
            WHERE u.action IN ('insert', 'update')),
    cli AS (SELECT id_cliente, nombre AS cli_nombre FROM cliente),
    svc AS (SELECT DISTINCT cs.id_cliente FROM cliente_servicio cs JOIN servicio s ON s.id_servicio = cs.id_servicio
            WHERE s.nombre IS NOT NULL)
    SELECT w.login_id, 'colaborador' AS kind, CAST(w.id_persona AS VARCHAR) AS persona_id,
           CAST(r.id_colaborador AS VARCHAR) AS colaborador_id, CAST(r.id_cliente AS VARCHAR) AS cliente_id,
           w.nombre, w.correo, {cli_name} AS cliente_nombre,
           r.id_cliente IN (SELECT id_cliente FROM svc) AS has_services,
           {_context_head('w.nombre', cli_name)} AS context_head, {sql_lit(CONTEXT_TAIL)} AS context_tail
    FROM who w JOIN role r ON r.id_persona = w.id_persona LEFT JOIN cli cl ON cl.id_cliente = r.id_cliente
    UNION ALL
    SELECT login_id, 'analista', CAST(id_persona AS VARCHAR), {sql_lit(V.ZERO_UUID)}, {sql_lit(V.ZERO_UUID)},
           nombre, correo, {sql_lit(V.ANALYST_CLIENT_NAME)}, false,
           {_context_head('nombre', sql_lit(V.ANALYST_CLIENT_NAME))}, {sql_lit(CONTEXT_TAIL)}
    FROM who"""


@q("role_analyst", "upsert", "analyst_of_person")
def _role_analyst() -> str:
    return f"""
    SELECT p.id_persona, coalesce(a.id_analista, {md5_bigint("'analista'", 'p.id_persona')}) AS id_analista,
           CAST(coalesce(a.analyst_level, {V.NEW_ANALYST_LEVEL}) AS INTEGER) AS nivel,
           CASE WHEN a.id_analista IS NULL THEN 'created' ELSE 'existing' END AS action
    FROM {PERSONAS} p LEFT JOIN analyst_of_person a ON a.id_persona = p.id_persona"""


@q("default_assignee", "external", "analista")
def _default_assignee() -> str:
    from deskpark.sources.fixtures import DEFAULT_ASSIGNEE
    name = sql_lit(DEFAULT_ASSIGNEE.upper())
    return f"""
    WITH m AS (SELECT id_persona FROM external WHERE nombre ILIKE {name} ORDER BY provider, id_provider LIMIT 1)
    SELECT {name} AS assignee_name,
           (SELECT min(id_analista) FROM analista WHERE id_persona = (SELECT id_persona FROM m)) AS id_analista"""


@q("normalize_status", "status_cmd")
def _norm_status() -> str:
    return f"SELECT cmd_id, status, {status_from_ui('status')} AS db_status FROM status_cmd"


@q("normalize_level", "status_cmd")
def _norm_level() -> str:
    return f"SELECT cmd_id, level, {level_from_ui('level')} AS db_level FROM status_cmd"


@q("status_validate", "status_valid")
def _status_validate() -> str:
    return "SELECT * FROM status_valid"


@q("status_apply", "ticket", "status_valid")
def _status_apply() -> str:
    last = "ORDER BY ts DESC, cmd_id DESC"
    return f"""
    WITH fold AS (
      SELECT id_ticket, first(db_status {last}) AS n_estado, max(ts) AS n_updated_at,
             max(ts) FILTER (WHERE db_status = 'finalizado') AS n_closed_at,
             first(substr(description, 1, {V.DIAGNOSIS_MAX_CHARS}) {last})
               FILTER (WHERE db_status = 'finalizado' AND description IS NOT NULL AND description <> '')
               AS n_diagnostico,
             first(db_level {last}) FILTER (WHERE level_code = 200) AS n_nivel
      FROM status_valid WHERE status_code = 200 GROUP BY id_ticket)
    SELECT t.id_ticket, t.id_colaborador, t.id_cliente_servicio, t.id_analista, t.asunto, t.tipo,
           coalesce(f.n_nivel, t.nivel) AS nivel,
           CASE WHEN f.n_estado IS NOT NULL THEN f.n_estado ELSE t.estado END AS estado,
           coalesce(f.n_diagnostico, t.diagnostico) AS diagnostico, t.created_at,
           CASE WHEN f.n_estado IS NOT NULL THEN f.n_updated_at ELSE t.updated_at END AS updated_at,
           coalesce(f.n_closed_at, t.closed_at) AS closed_at
    FROM ticket t LEFT JOIN fold f ON f.id_ticket = t.id_ticket"""


@q("escalation_candidates", "escalation_cmd", "analyst_of_person", "esc_off", "esc_pos")
def _esc_candidates() -> str:
    return f"""
    SELECT c.cmd_id, a.id_analista AS issuer, a.analyst_level AS issuer_level,
           CAST(coalesce(o.n_above, 0) AS BIGINT) AS n_candidates, p.id_analista AS id_candidate
    FROM escalation_cmd c JOIN analyst_of_person a ON a.id_persona = c.id_persona
    LEFT JOIN esc_off o ON o.nivel = a.analyst_level
    LEFT JOIN esc_pos p ON o.n_above > 0 AND p.pos = {md5_bigint('7', 'c.cmd_id')} % nullif(o.n_above, 0)"""


@q("escalation_validate", "esc_valid")
def _esc_validate() -> str:
    return "SELECT * FROM esc_valid"


@q("escalation_apply", "ticket", "esc_valid")
def _esc_apply() -> str:
    return """
    WITH last AS (SELECT id_ticket, first(id_analista_derivado ORDER BY ts DESC, cmd_id DESC) AS n_analista
                  FROM esc_valid WHERE code = 200 GROUP BY 1)
    SELECT t.id_ticket, t.id_colaborador, t.id_cliente_servicio, coalesce(l.n_analista, t.id_analista) AS id_analista,
           t.asunto, t.tipo, t.nivel, t.estado, t.diagnostico, t.created_at, t.updated_at, t.closed_at
    FROM ticket t LEFT JOIN last l ON l.id_ticket = t.id_ticket"""


@q("escalation_log", "escalado", "esc_valid")
def _esc_log() -> str:
    return """
    SELECT CAST((SELECT coalesce(max(id_escalado), 0) FROM escalado)
                + row_number() OVER (ORDER BY ts, cmd_id) AS BIGINT) AS id_escalado,
           id_ticket, id_analista_solicitante, id_analista_derivado, motivo, cmd_id
    FROM esc_valid WHERE code = 200"""


def _intake_sql() -> str:
    from deskpark.sources.fixtures import DEFAULT_ASSIGNEE
    name = sql_lit(DEFAULT_ASSIGNEE.upper())
    types = ", ".join(sql_lit(x) for x in V.TICKET_TYPES)
    levels = ", ".join(sql_lit(x) for x in V.TICKET_LEVELS)
    return f"""
    WITH r AS (
      SELECT r.*, h.id_cliente_servicio,
             CASE WHEN r.tipo IS NULL OR r.nivel IS NULL OR NOT (r.tipo IN ({types}) AND r.nivel IN ({levels}))
                  THEN 'invalid' WHEN h.id_cliente_servicio IS NULL THEN 'rejected' ELSE 'created' END AS outcome
      FROM intake_req r LEFT JOIN service_hits h ON h.req_id = r.req_id),
    ids AS (SELECT req_id, CAST((SELECT coalesce(max(id_ticket), 0) FROM ticket)
                                + row_number() OVER (ORDER BY ts, req_id) AS BIGINT) AS id_ticket
            FROM r WHERE outcome = 'created'),
    m AS (SELECT id_persona FROM external WHERE nombre ILIKE {name} ORDER BY provider, id_provider LIMIT 1),
    da AS (SELECT min(id_analista) AS id_analista FROM analista WHERE id_persona = (SELECT id_persona FROM m))
    SELECT r.req_id, r.outcome, i.id_ticket, r.id_colaborador,
           CASE WHEN r.outcome = 'created' THEN r.id_cliente_servicio END AS id_cliente_servicio,
           CASE WHEN r.outcome = 'created' THEN (SELECT id_analista FROM da) END AS id_analista,
           r.asunto, r.tipo, r.nivel, CASE WHEN r.outcome = 'created' THEN {sql_lit(V.STATUS_NEW)} END AS estado,
           CASE WHEN r.outcome = 'created' THEN r.ts END AS created_at, r.thread_id
    FROM r LEFT JOIN ids i ON i.req_id = r.req_id"""


@q("ticket_intake", "intake_req", "service_hits", "ticket", "external", "analista")
def _intake() -> str:
    return _intake_sql()


@q("ticket_receipts", "intake_req", "service_hits", "ticket", "external", "analista")
def _receipts() -> str:
    ok0, ok1 = V.RECEIPT_OK.split("{id}")
    ok1a, ok1b = ok1.split("{ts}")
    return f"""
    WITH intake AS ({_intake_sql()})
    SELECT req_id, outcome,
           CASE WHEN outcome = 'created' THEN {sql_lit(ok0)} || CAST(id_ticket AS VARCHAR) || {sql_lit(ok1a)}
                     || strftime(created_at, '%d/%m/%Y %H:%M:%S') || {sql_lit(ok1b)}
                WHEN outcome = 'rejected' THEN {sql_lit(V.RECEIPT_FAIL)} END AS reply
    FROM intake"""


def _tokens(expr: str) -> str:
    from deskpark.operators.retrieval import TOKEN_SPLIT
    return f"list_filter(string_split_regex(lower({expr}), '{TOKEN_SPLIT}'), lambda x: x <> '')"


def _bm25_sql(k: int) -> str:
    from deskpark.operators.retrieval import B, K1
    return f"""
    dt AS (SELECT doc_id, {_tokens('text')} AS toks FROM kb_document),
    stats AS (SELECT doc_id, len(toks) AS dl FROM dt),
    corpus AS (SELECT (SELECT count(*) FROM kb_document) AS n_docs, avg(dl) AS avgdl FROM stats),
    qt AS (SELECT DISTINCT conv_id, turn, unnest({_tokens('q')}) AS term FROM kb_question),
    postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dt)
                 WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
    dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
    contrib AS (
      SELECT q.conv_id, q.turn, p.doc_id,
             ln(1 + (c.n_docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * {K1 + 1}
               / (p.tf + {K1} * ({1 - B} + {B} * s.dl / c.avgdl)) AS w
      FROM qt q JOIN postings p ON p.term = q.term JOIN dfs d ON d.term = q.term
      JOIN stats s ON s.doc_id = p.doc_id, corpus c),
    scores AS (SELECT conv_id, turn, doc_id, round(sum(w), 6) AS score FROM contrib GROUP BY 1, 2, 3),
    topk AS (SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
               SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id) AS rank FROM scores)
             WHERE rank <= {k})"""


@q("kb_topk", "kb_document", "kb_question")
def _kb_topk() -> str:
    return f"WITH {_bm25_sql(V.KB_TOP_K)} SELECT * FROM topk"


@q("kb_context", "kb_document", "kb_question")
def _kb_context() -> str:
    return f"""WITH {_bm25_sql(V.KB_TOP_K)},
    ctx AS (SELECT t.conv_id, t.turn, count(*) AS n_docs,
                   string_agg(d.text, {sql_lit(V.KB_DOC_SEPARATOR)} ORDER BY t.rank) AS context
            FROM topk t JOIN kb_document d ON d.doc_id = t.doc_id GROUP BY 1, 2)
    SELECT q.conv_id, q.turn, coalesce(c.n_docs, 0) AS n_docs, coalesce(c.context, '') AS context
    FROM kb_question q LEFT JOIN ctx c ON c.conv_id = q.conv_id AND c.turn = q.turn"""


@q("kb_unanswered", "kb_document", "kb_question")
def _kb_unanswered() -> str:
    return f"""
    WITH qt AS (SELECT DISTINCT conv_id, turn, unnest({_tokens('q')}) AS term FROM kb_question),
    used AS (SELECT DISTINCT term FROM (SELECT unnest({_tokens('text')}) AS term FROM kb_document)
             WHERE term IN (SELECT term FROM qt))
    SELECT conv_id, turn, q FROM kb_question
    WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM qt WHERE term IN (SELECT term FROM used))"""


def _triage_sql(table: dict, label_col: str, pick: str, default: str) -> str:
    rows = ", ".join(f"({sql_lit(label)}, {rank}, {sql_lit(kw)})"
                     for rank, (label, kws) in enumerate(table.items()) for kw in kws)
    return f"""
    WITH rules(label, rank, term) AS (VALUES {rows}),
    words AS (SELECT id_ticket, unnest({_tokens('content')}) AS term FROM mensaje WHERE role = 'user'),
    hits AS (SELECT w.id_ticket, r.label, r.rank, count(*) AS hits FROM words w JOIN rules r ON r.term = w.term
             GROUP BY 1, 2, 3),
    best AS (SELECT id_ticket, label, hits FROM (
               SELECT *, row_number() OVER (PARTITION BY id_ticket ORDER BY {pick}) AS r FROM hits) WHERE r = 1)
    SELECT t.id_ticket, coalesce(b.label, {sql_lit(default)}) AS {label_col}, coalesce(b.hits, 0) AS hits
    FROM (SELECT DISTINCT id_ticket FROM mensaje) t LEFT JOIN best b ON b.id_ticket = t.id_ticket"""


@q("triage_type", "mensaje")
def _triage_type() -> str:
    from deskpark.operators.triage import TYPE_DEFAULT, TYPE_KEYWORDS
    return _triage_sql(TYPE_KEYWORDS, "tipo", "hits DESC, rank", TYPE_DEFAULT)


@q("triage_urgency", "mensaje")
def _triage_urgency() -> str:
    from deskpark.operators.triage import LEVEL_DEFAULT, LEVEL_KEYWORDS
    return _triage_sql(LEVEL_KEYWORDS, "nivel", "rank", LEVEL_DEFAULT)


@q("intake_conversations", "intake_req", "service_hits", "ticket", "external", "analista", "conv_json")
def _intake_conversations() -> str:
    return f"""
    WITH intake AS ({_intake_sql()})
    SELECT i.id_ticket, i.thread_id, CAST(coalesce(c.n_messages, 0) AS INTEGER) AS n_messages,
           coalesce(c.contenido, '[]') AS contenido
    FROM intake i LEFT JOIN conv_json c ON c.id_ticket = i.thread_id
    WHERE i.outcome = 'created'"""


@q("ticket_append", "intake_req", "service_hits", "ticket", "external", "analista")
def _ticket_append() -> str:
    return f"""
    WITH intake AS ({_intake_sql()})
    SELECT id_ticket, id_colaborador, id_cliente_servicio, id_analista, asunto, tipo, nivel, estado,
           CAST(NULL AS VARCHAR) AS diagnostico, created_at, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS TIMESTAMP) AS closed_at
    FROM intake WHERE outcome = 'created'"""


@q("conversation_append", "intake_req", "service_hits", "ticket", "external", "analista", "conv_json")
def _conversation_append() -> str:
    return f"""
    WITH intake AS ({_intake_sql()})
    SELECT i.id_ticket, coalesce(c.contenido, '[]') AS contenido
    FROM intake i LEFT JOIN conv_json c ON c.id_ticket = i.thread_id
    WHERE i.outcome = 'created'"""


@q("escalation_append", "escalado", "esc_valid")
def _escalation_append() -> str:
    return """
    SELECT CAST((SELECT coalesce(max(id_escalado), 0) FROM escalado)
                + row_number() OVER (ORDER BY ts, cmd_id) AS BIGINT) AS id_escalado,
           id_ticket, id_analista_solicitante, id_analista_derivado, motivo
    FROM esc_valid WHERE code = 200"""
