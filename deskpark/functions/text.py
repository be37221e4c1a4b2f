"""Scalar column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskpark.functions import vocab

# Characters Python's ``str.strip()`` removes (``str.isspace``). Spark's
# ``trim`` only removes spaces, so we strip with a regular expression.
_PY_SPACE = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
PY_STRIP_PATTERN = rf"^{_PY_SPACE}+|{_PY_SPACE}+$"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: leading and trailing whitespace of any kind."""
    return F.regexp_replace(col_(c), PY_STRIP_PATTERN, "")


def literal_map(mapping: dict) -> Column:
    """A ``map<string,string>`` literal (constant folded by Catalyst)."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def status_from_ui(raw: Column | str) -> Column:
    """UI status word -> stored status, NULL when unknown."""
    return F.element_at(literal_map(vocab.STATUS_UI_TO_DB), py_strip(F.lower(col_(raw))))


def level_from_ui(raw: Column | str) -> Column:
    """UI urgency word -> stored urgency, NULL when unknown."""
    return F.element_at(literal_map(vocab.LEVEL_UI_TO_DB), py_strip(F.lower(col_(raw))))


def contains_pattern(q: Column | str) -> Column:
    """``'%' || q || '%'`` as a LIKE pattern with PostgreSQL's backslash rule.

    PostgreSQL reads ``\\x`` as a plain ``x``; Spark rejects an escape before
    an ordinary character. Keep ``\\%``, ``\\_`` and ``\\\\`` and drop any other
    lone backslash. ``%`` and ``_`` in the user text stay wildcards (T5).
    """
    pattern = F.concat(F.lit("%"), col_(q), F.lit("%"))
    return F.regexp_replace(pattern, r"(\\[%_\\])|\\(.)", "$1$2")


def ilike(text: Column | str, pattern: Column | str) -> Column:
    """Match against a pattern that ``contains_pattern`` made."""
    return F.ilike(col_(text), col_(pattern), F.lit("\\"))


def ilike_contains(text: Column | str, q: Column | str) -> Column:
    return ilike(text, contains_pattern(q))


def uuid_or_null(c: Column | str) -> Column:
    """Canonical lower-case UUID text, or NULL when it does not parse.

    Python's ``uuid.UUID(x)`` drops ``urn:`` / ``uuid:``, strips braces and
    removes every hyphen, then needs 32 hex digits. A malformed id then
    matches nothing instead of failing the job. (``int()``'s tolerance of
    ``0x``, ``_`` and blanks inside those 32 characters is not copied.)
    """
    h = F.regexp_replace(col_(c), r"urn:|uuid:", "")
    h = F.regexp_replace(F.regexp_replace(h, r"^[{}]+|[{}]+$", ""), "-", "")
    lower = F.lower(h)
    canonical = F.concat_ws("-", F.substring(lower, 1, 8), F.substring(lower, 9, 4), F.substring(lower, 13, 4),
                            F.substring(lower, 17, 4), F.substring(lower, 21, 12))
    return F.when(h.rlike(r"^[0-9a-fA-F]{32}$"), canonical)


def guard_ids(df: DataFrame, *cols: str) -> DataFrame:
    """Apply ``uuid_or_null`` to string id columns of a request table.

    Integer ids (as in the generated test data) pass unchanged.
    """
    types = dict(df.dtypes)
    for c in cols:
        if types.get(c) == "string":
            df = df.withColumn(c, uuid_or_null(c))
    return df


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def ddmmyyyy(ts: Column | str) -> Column:
    """``strftime('%d/%m/%Y')``; NULL stays NULL.

    Built from the wall-clock fields, so no session time zone is involved.
    """
    t = col_(ts).cast("timestamp_ntz")
    return F.when(t.isNotNull(),
                  F.concat_ws("/", _pad(F.dayofmonth(t), 2), _pad(F.month(t), 2), _pad(F.year(t), 4)))


def ddmmyyyy_hms(ts: Column | str) -> Column:
    """``strftime('%d/%m/%Y %H:%M:%S')`` of a timestamp or date (a date gets 00:00:00)."""
    t = col_(ts).cast("timestamp_ntz")
    hms = F.concat_ws(":", _pad(F.hour(t), 2), _pad(F.minute(t), 2), _pad(F.floor(F.second(t)), 2))
    return F.when(t.isNotNull(), F.concat(ddmmyyyy(t), F.lit(" "), hms))


def py_str(c: Column | str) -> Column:
    """Python f-string rendering of a value: NULL prints ``None``."""
    return F.coalesce(col_(c).cast("string"), F.lit("None"))


def sla_due(created_at: Column | str, level: Column | str) -> Column:
    """created_at + response time of the urgency, NULL for unknown urgency."""
    due = None
    for name, (days, hours) in vocab.SLA_BY_LEVEL.items():
        value = col_(created_at) + F.make_dt_interval(F.lit(days), F.lit(hours))
        due = F.when(col_(level) == name, value) if due is None else due.when(col_(level) == name, value)
    return due


def md5_bigint(*parts: Column | str) -> Column:
    """A 60-bit integer from the md5 of ``':'.join(parts)``; same value in DuckDB."""
    digest = F.md5(F.concat_ws(":", *[col_(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
