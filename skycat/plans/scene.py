"""Processed catalogue -> capped, scaled point sets per tracer.

    projected scan (S5) -> cap (W2) -> present tracers (A5) -> scale (P8)
    -> one subset per tracer (W5), written ``partitionBy("tracer")``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skycat.functions.coords import scale_coords
from skycat.functions.hashing import DEFAULT_METHOD
from skycat.operators import sampling
from skycat.schema import SAMPLE_SEED, SCENE_MAX_POINTS, SCENE_SCALE
from skycat.sources.catalog import read_catalog


def scene_points(
    spark: SparkSession,
    catalog_path: str,
    *,
    max_points: int = SCENE_MAX_POINTS,
    scale: float = SCENE_SCALE,
    id_cols=("catalog", "row_index"),
    seed: int = SAMPLE_SEED,
    hash_method: str = DEFAULT_METHOD,
) -> DataFrame:
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    # projected scan (S5): Catalyst prunes the read to these columns
    pts = read_catalog(spark, catalog_path, with_identity=True).select("x", "y", "z_cart", "tracer", *ids)
    capped = sampling.cap_points(pts, max_points, id_cols=id_cols, seed=seed, hash_method=hash_method)
    return scale_coords(capped, scale)


def write_scene(df: DataFrame, path: str) -> None:
    """W5 as a sink: one directory per tracer, each a complete point set."""
    df.write.mode("overwrite").partitionBy("tracer").option("compression", "zstd").parquet(path)
