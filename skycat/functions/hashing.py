"""Reproducible per-row uniforms from a hash of the row's identity.

``rand(seed)`` depends on how rows fall into partitions, so it changes when a
file is split differently or a task is retried on another executor.  A hash of
(seed, salt, identity) does not: the same row always gets the same number, on
any partitioning, after any retry, and DuckDB computes the same value.

u = (int(first 13 hex digits of md5(text)) + 0.5) / 2^52, in (0, 1).
Optionally the top 52 bits of xxhash64 instead (faster, Spark only).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = float(2**52)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def identity(*cols) -> Column:
    """One string identity from one or more columns, ':'-joined."""
    if len(cols) == 1:
        return _c(cols[0]).cast("string")
    return F.concat_ws(":", *[_c(c).cast("string") for c in cols])


def hash52(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def hash52_sql(text_sql: str) -> str:
    return f"CAST('0x' || substr(md5({text_sql}), 1, 13) AS BIGINT)"


def salted_text(prefix: str, ident: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), ident)


HASH_METHODS = ("md5", "xxhash64")
#: About a quarter of md5's cost; md5 is for what a SQL twin must compute too.
DEFAULT_METHOD = "xxhash64"


def uniform(prefix: str, ident: Column, method: str = DEFAULT_METHOD) -> Column:
    """u(prefix) for the identity column (prefix is e.g. 'ra' or '42:key').

    ``md5`` has a SQL twin (DuckDB computes the same number); ``xxhash64`` is
    about 4x cheaper per row in Spark (no twin): the top 52 bits of
    xxhash64(prefix, identity).
    """
    if method == "md5":
        h = hash52(salted_text(prefix, ident))
    elif method == "xxhash64":
        h = F.shiftrightunsigned(F.xxhash64(F.lit(prefix + ":"), ident), 12)
    else:
        raise ValueError(f"hash method {method!r}; use one of {HASH_METHODS}")
    return (h.cast("double") + F.lit(0.5)) / F.lit(TWO52)


def uniform_sql(prefix: str, ident_sql: str) -> str:
    return f"((CAST({hash52_sql(repr_prefix(prefix) + ' || ' + ident_sql)} AS DOUBLE) + 0.5) / 4503599627370496.0)"


def repr_prefix(prefix: str) -> str:
    return "'" + (prefix + ":").replace("'", "''") + "'"
