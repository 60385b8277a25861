"""Aggregations A1-A6 and V1.

Every aggregation here groups by a low-cardinality key (file, tracer) or by
nothing, so Spark runs a partial aggregate in each task before the shuffle:
however skewed the tracers are, each task ships one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycat.functions.catalog import catalog_label, format_count, format_z_range, output_name, tracer_id
from skycat.operators.dims import bounded_broadcast, tracer_dim, tracer_name


def catalog_summary(df: DataFrame, *, file_col: str = "file_name", z: str = "Z", keep: Column | None = None) -> DataFrame:
    """A1: per input file, the rows that pass the cut and their redshift range.

    ``df`` holds one row per raw input row and a file-name column; ``keep`` is
    the quality mask.  Counting with a conditional aggregate in the same pass
    reports a file whose rows were all cut as 0 rows with a null range (the
    original raises on it) without a second scan or a join.
    """
    zf = F.col(z).cast("float")
    if keep is not None:
        zf = F.when(keep, zf)
    agg = df.groupBy(file_col).agg(
        F.count(zf).alias("n_galaxies"),
        F.min(zf).alias("z_min"),
        F.max(zf).alias("z_max"),
    )
    return agg.select(
        catalog_label(file_col).alias("catalog"),
        tracer_name(tracer_id(file_col)).alias("tracer"),
        "n_galaxies",
        format_count("n_galaxies").alias("galaxies"),
        "z_min",
        "z_max",
        format_z_range("z_min", "z_max").alias("z_range"),
        output_name(file_col).alias("output"),
    )


def catalog_summary_processed(df: DataFrame) -> DataFrame:
    """A1 over an already processed catalogue (``catalog``, ``tracer``, ``z``)."""
    agg = df.groupBy("catalog", "tracer").agg(
        F.count(F.lit(1)).alias("n_galaxies"), F.min("z").alias("z_min"), F.max("z").alias("z_max")
    )
    return agg.select(
        "catalog",
        tracer_name("tracer").alias("tracer"),
        "n_galaxies",
        format_count("n_galaxies").alias("galaxies"),
        "z_min",
        "z_max",
        format_z_range("z_min", "z_max").alias("z_range"),
    )


def catalog_total(df: DataFrame) -> DataFrame:
    """A2 (and A6 on decoded points): one row, ``n_galaxies``."""
    return df.agg(F.count(F.lit(1)).alias("n_galaxies"))


def tracer_counts(df: DataFrame, name: str = "n") -> DataFrame:
    return df.groupBy("tracer").agg(F.count(F.lit(1)).alias(name))


def sample_summary(available: DataFrame, sample: DataFrame) -> DataFrame:
    """A3: per tracer, rows available and rows sampled; absent tracers left out.

    Both sides are aggregated to one row per tracer first, so the join is
    between two tiny tables.
    """
    a = tracer_counts(available, "available")
    s = tracer_counts(sample, "sampled")
    return a.join(s, "tracer", "inner").select(
        "tracer", tracer_name("tracer").alias("name"), "available", "sampled"
    )


def sample_summary_from_stats(spark, available: dict[int, int], sample: DataFrame) -> DataFrame:
    """A3 when the per-tracer row counts are already known (W1 computes them):
    only the sample is aggregated."""
    a = spark.createDataFrame([(int(t), int(n)) for t, n in available.items()], "tracer short, available bigint")
    s = tracer_counts(sample, "sampled")
    return a.join(s, "tracer", "inner").select("tracer", tracer_name("tracer").alias("name"), "available", "sampled")


def bounds(df: DataFrame) -> DataFrame:
    """A4: min and max of x, y, z_cart as doubles, one row."""
    aggs = []
    for c in ("x", "y", "z_cart"):
        aggs += [F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max")]
    return df.agg(*aggs)


def present_tracers(df: DataFrame) -> DataFrame:
    """A5: sorted distinct tracer ids (partial distinct per task, then merge)."""
    return df.select("tracer").distinct().orderBy("tracer")


def validate_catalog(df: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """V1: per tracer: rows, rows outside the tracer's redshift range,
    non-finite positions, non-positive weights.

    The range comes from the 4-row tracer dimension, broadcast to the tasks.
    Unknown tracers are reported with a null range (nothing counted outside).
    """
    if dim is None:  # the built-in dimension: four rows, no need to count them
        side = F.broadcast(tracer_dim(df.sparkSession).select("tracer", "z_min", "z_max"))
    else:
        side = bounded_broadcast(dim.select("tracer", "z_min", "z_max"))
    j = df.join(side, "tracer", "left")
    z = F.col("z").cast("double")
    nonfinite = None
    for c in ("ra", "dec", "z", "x", "y", "z_cart"):
        bad = F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
        nonfinite = bad if nonfinite is None else nonfinite | bad
    return j.groupBy("tracer").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((z < F.col("z_min")) | (z > F.col("z_max"))).alias("n_outside_range"),
        F.count_if(nonfinite).alias("n_nonfinite"),
        F.count_if(~(F.col("weight") > 0) | F.isnan("weight")).alias("n_nonpositive_weight"),
    ).select("tracer", tracer_name("tracer").alias("name"), "n_rows", "n_outside_range", "n_nonfinite", "n_nonpositive_weight")
