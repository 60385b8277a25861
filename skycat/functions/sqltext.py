"""Helpers for writing the DuckDB-side (oracle) SQL twins of our expressions."""

from __future__ import annotations

import math


def dlit(x: float) -> str:
    """An exact DOUBLE literal.  Plain ``0.5`` would be a DECIMAL in DuckDB."""
    x = float(x)
    if math.isnan(x):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(x):
        return "CAST('Infinity' AS DOUBLE)" if x > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"CAST('{x!r}' AS DOUBLE)"


def slit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"
