"""Fixed values of the support-desk domain.

FIXED VALUES: these words, maps and sentences must equal the ones the
reference application uses, so that results agree. They are stated here
plainly and in their natural order; nothing else in the package repeats them.
"""

from __future__ import annotations

# FIXED VALUES: status word from the UI -> stored ticket status.
STATUS_UI_TO_DB = {
    "abierto": "aceptado",
    "en atención": "en atención",
    "en atencion": "en atención",
    "cerrado": "finalizado",
    "finalizado": "finalizado",
    "cancelado": "cancelado",
    "rechazado": "cancelado",
}

# FIXED VALUES: urgency word from the UI -> stored ticket urgency.
LEVEL_UI_TO_DB = {
    "bajo": "bajo",
    "medio": "medio",
    "alto": "alto",
    "crítico": "crítico",
    "critico": "crítico",
}

# FIXED VALUES: ticket type and urgency domains.
TICKET_TYPES = ("incidencia", "solicitud")
TICKET_LEVELS = ("bajo", "medio", "alto", "crítico")

# FIXED VALUES: stored status names with a meaning in the rules.
STATUS_NEW = "aceptado"
STATUS_CLOSED = "finalizado"
FILTER_ALL = "todos"

# FIXED VALUES: response time per urgency, as (days, hours).
SLA_BY_LEVEL = {
    "bajo": (4, 0),
    "medio": (2, 0),
    "alto": (1, 0),
    "crítico": (0, 4),
}

# FIXED VALUES: limits.
DIAGNOSIS_MAX_CHARS = 5000
ESCALATION_REASON_MIN_CHARS = 10
ESCALATION_MAX_LEVEL = 3
NEW_ANALYST_LEVEL = 1
PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX = 20, 100
RECENT_TICKETS = 10
KB_TOP_K = 5

# FIXED VALUES: names and constants.
DEFAULT_ASSIGNEE_NAME = "Ana Lytics"
DEFAULT_CLIENT_NAME = "Gmail"
PROVIDER = "google"
ACCEPTED_ISSUERS = ("accounts.google.com", "https://accounts.google.com")
UNKNOWN_CLIENT = "Cliente Desconocido"
ANALYST_CLIENT_NAME = "ANALYTICS"
ZERO_UUID = "00000000-0000-0000-0000-000000000000"
NO_SERVICES = "Ninguno"

# FIXED VALUES: conversation roles (human -> "user", AI -> "agent").
ROLE_RENAME = {"user": "user", "assistant": "agent"}

# FIXED VALUES: sentences and labels of the ticket tools.
CARD_NO_ANALYST = "Aún no asignado"
CARD_NO_SERVICE = "No disponible"
CARD_NO_DATE = "-"
REPLY_ONE_FOUND = "He encontrado los detalles del ticket solicitado:\n"
REPLY_ONE_MISSING = "No encontré el ticket #{id} o no tienes permiso para verlo."
REPLY_OPEN_FOUND = "He encontrado los siguientes tickets abiertos:"
REPLY_OPEN_EMPTY = "Usted no tiene tickets abiertos actualmente."
REPLY_ALL_FOUND = "He encontrado los siguientes tickets:"
REPLY_ALL_EMPTY = "Usted no tiene tickets actualmente."
REPLY_SUBJECT_FOUND = "He encontrado los siguientes tickets relacionados con '{q}':"
REPLY_SUBJECT_EMPTY = "No encontré tickets cuyo asunto contenga '{q}'."
RECEIPT_OK = "He generado el ticket **#{id}** con su solicitud. Fecha de creación del ticket: {ts}."
RECEIPT_FAIL = "Lo siento, ocurrió un error inesperado al intentar crear su ticket."

# FIXED VALUES: separator between retrieved documents in the tool output.
KB_DOC_SEPARATOR = "\n\n"
