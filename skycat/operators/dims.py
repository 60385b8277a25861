"""D4 tracer dimension, D5 manifest, J1 dimension lookups.

The dimension tables have a fixed, tiny size (four tracers, ten files), so
broadcasting them is safe at any catalogue size; the big side is never moved.
Single-attribute lookups use an inline CASE instead of a join, which keeps them
inside the same codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.schema import MANIFEST, TRACER_DIM_SCHEMA, TRACERS, UNKNOWN_RGB


def tracer_dim(spark: SparkSession, targets: dict[int, int] | None = None) -> DataFrame:
    """tracer short, name, color, rgb array<float>, z_min, z_max, target."""
    rows = [
        (t, name, color, list(rgb), zr[0], zr[1], int((targets or {}).get(t, target)))
        for t, name, color, rgb, zr, target in TRACERS
    ]
    return spark.createDataFrame(rows, TRACER_DIM_SCHEMA)


def manifest_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in MANIFEST], "file_name string")


def tracer_name(tracer) -> Column:
    """Id -> name; an unknown id shows as the id itself."""
    t = F.col(tracer) if isinstance(tracer, str) else tracer
    expr = None
    for tid, name, *_ in TRACERS:
        expr = F.when(t == tid, F.lit(name)) if expr is None else expr.when(t == tid, F.lit(name))
    return expr.otherwise(t.cast("string"))


def tracer_name_sql(t: str) -> str:
    arms = " ".join(f"WHEN {t} = {tid} THEN '{name}'" for tid, name, *_ in TRACERS)
    return f"CASE {arms} ELSE CAST({t} AS VARCHAR) END"


# A tracer id is a u8: a tracer dimension has at most this many rows.
MAX_DIM_ROWS = 256


def bounded_broadcast(dim: DataFrame, limit: int = MAX_DIM_ROWS) -> DataFrame:
    """``broadcast(dim)`` when it has at most ``limit`` rows (checked), else
    ``dim`` unchanged (Spark then picks the join; AQE can still broadcast)."""
    return F.broadcast(dim) if dim.limit(limit + 1).count() <= limit else dim


def with_tracer_dim(df: DataFrame, dim: DataFrame, cols=("name", "color", "rgb")) -> DataFrame:
    """Left join to the tracer dimension (broadcast after a size check);
    unmatched rows keep nulls."""
    return df.join(bounded_broadcast(dim.select("tracer", *cols)), "tracer", "left")


def tracer_rgb(tracer) -> Column:
    """Tracer -> RGB array<float>; unknown tracers are white."""
    t = F.col(tracer) if isinstance(tracer, str) else tracer

    def rgb(values):
        return F.array(*[F.lit(float(v)).cast("float") for v in values])

    expr = None
    for tid, _name, _color, values, *_ in TRACERS:
        expr = F.when(t == tid, rgb(values)) if expr is None else expr.when(t == tid, rgb(values))
    return expr.otherwise(rgb(UNKNOWN_RGB))


def color_points(df: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Tracer -> RGB (unknown -> white), default size 1.5 and alpha 0.7.

    The fixed four-entry palette is an inline lookup (same codegen stage, no
    broadcast job); pass ``dim`` to colour from another dimension table
    instead (broadcast left join, J1).
    """
    from skycat.schema import DEFAULT_OPACITY, DEFAULT_POINT_SIZE

    if dim is None:
        out = df.withColumn("rgb", tracer_rgb("tracer"))
    else:
        white = F.array(*[F.lit(v).cast("float") for v in UNKNOWN_RGB])
        out = with_tracer_dim(df, dim, cols=("rgb",)).withColumn("rgb", F.coalesce(F.col("rgb"), white))
    return out.withColumns(
        {
            "size": F.lit(DEFAULT_POINT_SIZE).cast("float"),
            "alpha": F.lit(DEFAULT_OPACITY).cast("float"),
        }
    )
