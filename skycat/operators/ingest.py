"""E1 row work: raw catalogue rows -> processed catalogue (D2 + provenance).

P1 tracer from the file name, P3 label, P5 quality cut on the doubles, P6
distance, P7 Cartesian position, P4 narrowing to f32.  One narrow projection:
no shuffle, no Python; Catalyst pushes the cut into the scan where it can.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycat.functions.catalog import catalog_label, quality_mask, tracer_id
from skycat.functions.coords import sky_to_cartesian
from skycat.functions.cosmology import comoving_distance
from skycat.schema import CATALOG_COLUMNS, H0, OM0


def to_cartesian(
    raw: DataFrame,
    *,
    ra: str = "RA",
    dec: str = "DEC",
    z: str = "Z",
    weight: str = "WEIGHT",
    h0: float = H0,
    om0: float = OM0,
) -> DataFrame:
    """Add ra, dec, z, x, y, z_cart, weight (all f32) computed from the raw doubles.

    Raw columns stay available until the caller projects them away.
    """
    dist = comoving_distance(F.col(z), h0, om0)
    x, y, zc = sky_to_cartesian(F.col(ra), F.col(dec), F.col("_dist"))
    return (
        raw.withColumn("_dist", dist)
        .withColumns(
            {
                "x": x.cast("float"),
                "y": y.cast("float"),
                "z_cart": zc.cast("float"),
            }
        )
        .withColumns(
            {
                "ra": F.col(ra).cast("float"),
                "dec": F.col(dec).cast("float"),
                "z": F.col(z).cast("float"),
                "weight": F.col(weight).cast("float"),
            }
        )
        .drop("_dist")
    )


def process_catalog(
    raw: DataFrame,
    *,
    file_col: str = "file_name",
    keep: tuple[str, ...] = (),
    ra: str = "RA",
    dec: str = "DEC",
    z: str = "Z",
    weight: str = "WEIGHT",
    h0: float = H0,
    om0: float = OM0,
) -> DataFrame:
    """Raw rows (with a file-name column) -> D2 columns + ``catalog`` + ``keep`` columns.

    The cut runs on the doubles before narrowing, as the original does.
    """
    cut = raw.where(quality_mask(ra, dec, z))
    out = to_cartesian(cut, ra=ra, dec=dec, z=z, weight=weight, h0=h0, om0=om0).withColumns(
        {"tracer": tracer_id(file_col), "catalog": catalog_label(file_col)}
    )
    return out.select(*CATALOG_COLUMNS, "catalog", *keep)


def combine_catalogs(*parts: DataFrame) -> DataFrame:
    """Bag union by column name; duplicates across catalogues are kept."""
    return reduce(lambda a, b: a.unionByName(b), parts)
