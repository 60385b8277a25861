"""P1 tracer id, P3 catalogue label, P5 quality cut, P9/P10 redshift codec,
P14 console formatting.  All built-in Column expressions (whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skycat.functions.sqltext import dlit, slit
from skycat.schema import (
    CATALOG_SUFFIX,
    DEFAULT_TRACER,
    QUALITY_Z_MAX,
    QUALITY_Z_MIN,
    TRACER_PREFIXES,
    Z_ENCODE_MAX,
    Z_ENCODE_SCALE,
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- P1 ---------------------------------------------------------------------
def tracer_id(file_name) -> Column:
    """First matching prefix wins; no match -> 0.  Result is a short."""
    name = _c(file_name)
    expr = None
    for prefix, tid in TRACER_PREFIXES:
        cond = name.startswith(prefix)
        expr = F.when(cond, F.lit(tid)) if expr is None else expr.when(cond, F.lit(tid))
    return expr.otherwise(F.lit(DEFAULT_TRACER)).cast("short")


def tracer_id_sql(name_sql: str) -> str:
    arms = " ".join(f"WHEN starts_with({name_sql}, {slit(p)}) THEN {t}" for p, t in TRACER_PREFIXES)
    return f"CAST(CASE {arms} ELSE {DEFAULT_TRACER} END AS SMALLINT)"


# -- P3 ---------------------------------------------------------------------
def catalog_label(file_name) -> Column:
    """'LRG_N_clustering.dat.fits' -> 'LRG_N'."""
    return F.replace(_c(file_name), F.lit(CATALOG_SUFFIX), F.lit(""))


def catalog_label_sql(name_sql: str) -> str:
    return f"replace({name_sql}, {slit(CATALOG_SUFFIX)}, '')"


def output_name(file_name) -> Column:
    """'X.dat.fits' -> 'X.dat.parquet' (last suffix swapped)."""
    return F.regexp_replace(_c(file_name), r"\.[^.]*$", ".parquet")


def output_name_sql(name_sql: str) -> str:
    return f"regexp_replace({name_sql}, '\\.[^.]*$', '.parquet')"


# -- P5 ---------------------------------------------------------------------
def is_finite(c) -> Column:
    c = _c(c)
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def quality_mask(ra="RA", dec="DEC", z="Z") -> Column:
    """0.001 < z < 5.0 (strict) and finite ra, dec.  NaN z fails `z < 5`."""
    z = _c(z)
    return (z > F.lit(QUALITY_Z_MIN)) & (z < F.lit(QUALITY_Z_MAX)) & is_finite(ra) & is_finite(dec)


def quality_mask_sql(ra="RA", dec="DEC", z="Z") -> str:
    # DuckDB orders NaN above +inf as Spark does; isfinite covers NaN and inf.
    return f"({z} > {dlit(QUALITY_Z_MIN)} AND {z} < {dlit(QUALITY_Z_MAX)} AND isfinite({ra}) AND isfinite({dec}))"


def quality_cut(df, ra="RA", dec="DEC", z="Z"):
    return df.where(quality_mask(ra, dec, z))


# -- P9 / P10 ----------------------------------------------------------------
def encode_z(z) -> Column:
    """f32 z * 10000 in f32, clipped to [0, 65535], truncated -> int.

    Int, not short: 65535 does not fit a smallint and ANSI casts would raise.
    """
    v = _c(z).cast("float") * F.lit(float(Z_ENCODE_SCALE)).cast("float")
    v = F.least(F.greatest(v, F.lit(0.0).cast("float")), F.lit(float(Z_ENCODE_MAX)).cast("float"))
    return v.cast("int")


def encode_z_sql(z_sql: str) -> str:
    v = f"(CAST({z_sql} AS FLOAT) * CAST({Z_ENCODE_SCALE} AS FLOAT))"
    v = f"least(greatest({v}, CAST(0 AS FLOAT)), CAST({Z_ENCODE_MAX} AS FLOAT))"
    return f"CAST(trunc({v}) AS INTEGER)"


def decode_z(q) -> Column:
    return (_c(q).cast("double") / F.lit(float(Z_ENCODE_SCALE))).cast("float")


def decode_z_sql(q_sql: str) -> str:
    return f"CAST(CAST({q_sql} AS DOUBLE) / {dlit(Z_ENCODE_SCALE)} AS FLOAT)"


# -- P14 ---------------------------------------------------------------------
def format_count(n) -> Column:
    """1234567 -> '1,234,567'."""
    return F.format_number(_c(n), 0)


def format_count_sql(n_sql: str) -> str:
    return f"format('{{:,}}', {n_sql})"


def format_z_range(zmin, zmax) -> Column:
    """'0.012–0.598' (en dash, three decimals)."""
    return F.format_string("%.3f–%.3f", _c(zmin).cast("double"), _c(zmax).cast("double"))


def format_z_range_sql(zmin_sql: str, zmax_sql: str) -> str:
    return f"printf('%.3f–%.3f', CAST({zmin_sql} AS DOUBLE), CAST({zmax_sql} AS DOUBLE))"
