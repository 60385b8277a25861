"""K3/S6 packed points and K4/S7 metadata document, at the DataFrame level."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.functions.catalog import decode_z, encode_z
from skycat.schema import (
    COSMOLOGY_MODEL,
    DATA_RELEASE,
    H0,
    METADATA_SCHEMA,
    METADATA_VERSION,
    OM0,
    TRACERS,
)
from skycat.sources import fsio, galbin


def pack_points(df: DataFrame) -> DataFrame:
    """The record columns of the packed file (z quantised in Spark)."""
    return df.select(
        F.col("x").cast("float"),
        F.col("y").cast("float"),
        F.col("z_cart").cast("float"),
        F.col("tracer").cast("short"),
        encode_z("z").alias("z_encoded"),
    )


def write_packed(df: DataFrame, path: str, *, single_file: bool = True, mode: str = "overwrite") -> None:
    """K3: write points (x, y, z_cart, tracer, z) as packed records, in row order.

    Every task writes its own parts.  With ``single_file`` (the viewer's layout) they go to a
    folder beside ``path`` and are composed into exactly ``path``, which a reader sees as it was
    until the new file is whole; otherwise ``path`` is a versioned folder of parts (``galbin``),
    to which ``mode`` "append" adds.
    """
    spark = df.sparkSession
    galbin.register(spark)
    path = fsio.qualified(spark, path)
    folder = path
    if single_file:
        folder = fsio.join(fsio.dirname(path), f".{fsio.name(path)}-{uuid.uuid4().hex}")
        mode = "overwrite"
    try:
        pack_points(df).write.format("galbin").mode(mode).option("path", folder).save()
        if single_file:
            galbin.compose(spark, galbin.list_files(folder), path)
    finally:
        if single_file:
            fsio.delete_folder(folder)


def read_packed(spark: SparkSession, path: str, records_per_partition: int | None = None) -> DataFrame:
    """S6 + P10: decoded points ``x, y, z_cart, tracer, z``."""
    galbin.register(spark)
    r = spark.read.format("galbin")
    if records_per_partition:
        r = r.option("recordsPerPartition", str(records_per_partition))
    df = r.load(fsio.qualified(spark, path))
    return df.select("x", "y", "z_cart", "tracer", decode_z("z_encoded").alias("z"))


def metadata_document(sample: DataFrame, *, h0: float = H0, om0: float = OM0, data_release: str = DATA_RELEASE) -> dict:
    """K4: the metadata document of an exported sample.

    Count and bounds come from one Spark aggregation (a single row reaches the
    driver); the tracer table and cosmology are fixed values.
    """
    agg = sample.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).cast("double").alias(f"{c}_{f.__name__}") for c in ("x", "y", "z_cart") for f in (F.min, F.max)],
    ).first()
    return {
        "version": METADATA_VERSION,
        "n_points": int(agg["n"]),
        "tracers": {
            str(t): {"name": name, "color": color, "z_range": [zr[0], zr[1]]} for t, name, color, _rgb, zr, _n in TRACERS
        },
        "bounds": {
            "x": [agg["x_min"], agg["x_max"]],
            "y": [agg["y_min"], agg["y_max"]],
            "z": [agg["z_cart_min"], agg["z_cart_max"]],
        },
        "cosmology": {"H0": h0, "Om0": om0, "model": COSMOLOGY_MODEL},
        "data_release": data_release,
    }


def write_metadata(doc: dict, path: str) -> None:
    """K4 sink: indented JSON text (the document is one small row); written to a
    temporary name and moved into place, on any file system pyarrow reaches."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    fsio.write_bytes(tmp, [json.dumps(doc, indent=2).encode("utf-8")])
    fsio.move(tmp, path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The document as a one-row DataFrame with the D8 schema."""
    return spark.read.schema(METADATA_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
