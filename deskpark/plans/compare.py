"""Order-insensitive comparison of query results (Spark rows vs DuckDB rows)."""

from __future__ import annotations

import datetime
import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def canonical(cols: list[str], records) -> list[tuple]:
    """Rows with columns in name order, values normalised, rows sorted."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))
