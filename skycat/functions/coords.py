"""P7 sky -> Cartesian, P8 scene scaling, P4 narrowing; all Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skycat.functions.sqltext import dlit

DEG2RAD = math.pi / 180.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def radians(c) -> Column:
    # Multiply by the constant (like numpy) rather than Spark's radians(), so
    # that the SQL twin below computes the same double.
    return _c(c).cast("double") * F.lit(DEG2RAD)


def sky_to_cartesian(ra, dec, dist) -> tuple[Column, Column, Column]:
    """Degrees + distance (double) -> (x, y, z_cart) doubles.

    x = d cos(dec) cos(ra); y = d cos(dec) sin(ra); z_cart = d sin(dec).
    """
    ra_r, dec_r, d = radians(ra), radians(dec), _c(dist)
    x = d * F.cos(dec_r) * F.cos(ra_r)
    y = d * F.cos(dec_r) * F.sin(ra_r)
    z = d * F.sin(dec_r)
    return x, y, z


def sky_to_cartesian_sql(ra: str, dec: str, dist: str) -> tuple[str, str, str]:
    ra_r = f"(CAST({ra} AS DOUBLE) * {dlit(DEG2RAD)})"
    dec_r = f"(CAST({dec} AS DOUBLE) * {dlit(DEG2RAD)})"
    return (
        f"({dist} * cos({dec_r}) * cos({ra_r}))",
        f"({dist} * cos({dec_r}) * sin({ra_r}))",
        f"({dist} * sin({dec_r}))",
    )


def scale_coords(df, factor: float, cols=("x", "y", "z_cart")):
    """Multiply position columns by a constant (Mpc -> scene units), keep f32."""
    return df.withColumns({c: (F.col(c) * F.lit(float(factor))).cast("float") for c in cols})
