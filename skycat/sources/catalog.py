"""Catalogue files: discovery (S1), manifest check (S2), FITS scan (S3),
Parquet scans (S4, S5) and writes (K1, K2)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.operators.layout import curve_ordered
from skycat.schema import CATALOG_GLOB, FITS_EXTENSION
from skycat.sources import fits, fsio
from skycat.sources.tables import scan_tasks


def discover_catalogs(spark: SparkSession, path: str, pattern: str = CATALOG_GLOB) -> DataFrame:
    """Catalogue files under ``path`` (path, file_name, length, modified), sorted.

    A ``binaryFile`` listing with the content column pruned: nothing is read
    but the directory entries.  Raises when nothing matches.
    """
    from pyspark.errors import AnalysisException

    try:
        listing = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true")
            .load(path)
        )
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no {pattern} files in {path}") from None
        raise
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    files = listing.select("path", name, "length", F.col("modificationTime").alias("modified")).orderBy("file_name", "path")
    if files.isEmpty():
        raise FileNotFoundError(f"no {pattern} files in {path}")
    return files


def manifest_status(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Every manifest entry with ``present`` true/false.

    Present entries are a left-semi join, missing ones a left-anti join.  The
    found names come from the data (one row per file), so no broadcast is
    forced: AQE broadcasts them at run time when they are measured small.
    """
    names = found.select("file_name").distinct()
    present = manifest.join(names, "file_name", "left_semi").withColumn("present", F.lit(True))
    missing = manifest.join(names, "file_name", "left_anti").withColumn("present", F.lit(False))
    return present.unionByName(missing)


def missing_catalogs(manifest: DataFrame, found: DataFrame) -> DataFrame:
    return manifest.join(found.select("file_name").distinct(), "file_name", "left_anti")


def read_raw(
    spark: SparkSession,
    path: str,
    *,
    extname: str = FITS_EXTENSION,
    pattern: str = CATALOG_GLOB,
    rows_per_partition: int | None = None,
    include_path: bool = False,
    files: list[str] | None = None,
    lengths: list[int] | None = None,
) -> DataFrame:
    """S3 (+P4 coercion): RA, DEC, Z as double and WEIGHT as float, with
    file_name and row_index (and path); of ``files`` under ``path``, if given
    (with their ``lengths``, if a listing has them: nothing is asked of a file then)."""
    fits.register(spark)
    r = (
        spark.read.format("fits_table")
        .option("extname", extname)
        .option("pattern", pattern)
        .option("columns", "RA,DEC,Z,WEIGHT")
        .option("includePath", str(include_path).lower())
        .option("minPartitions", str(spark.sparkContext.defaultParallelism))
    )
    if rows_per_partition:
        r = r.option("rowsPerPartition", str(rows_per_partition))
    if lengths is not None:
        r = r.option("lengths", json.dumps(lengths))
    df = r.load(fsio.qualified(spark, path)) if files is None else r.option("paths", json.dumps(files)).load()
    cols = [
        F.col("RA").cast("double").alias("RA"),
        F.col("DEC").cast("double").alias("DEC"),
        F.col("Z").cast("double").alias("Z"),
        F.col("WEIGHT").cast("float").alias("WEIGHT"),
        "file_name",
        "row_index",
    ]
    return df.select(*cols, *(["path"] if include_path else []))


def read_catalog(
    spark: SparkSession, path: str, columns: list[str] | None = None, *, with_identity: bool = False
) -> DataFrame:
    """The processed catalogue; ``columns`` prunes the scan.

    ``with_identity`` adds ``path`` and ``row_index`` from the Parquet scan's
    hidden metadata (file path, row position in the file) when the table has
    no ``row_index`` of its own, e.g. a catalogue written by another tool:
    a stable identity for the hash-keyed sampling.  Raises when the table is
    absent, as the original does.
    """
    from skycat.sources.tables import path_exists

    if not path_exists(spark, path):
        raise FileNotFoundError(f"combined catalogue not found: {path}")
    df = spark.read.parquet(path)
    keep = list(columns) if columns else list(df.columns)
    if with_identity and "row_index" not in df.columns:
        df = df.select(*keep, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))
        return df
    return df.select(*keep) if columns else df


def identity_columns(df: DataFrame) -> tuple[str, str]:
    """The row identity a catalogue carries: (path, row_index), (source, row_index) or (catalog, row_index)."""
    return (next((c for c in ("path", "source") if c in df.columns), "catalog"), "row_index")


def write_per_catalog(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ("catalog",)) -> None:
    """K1: one zstd Parquet directory per catalogue (``catalog=<label>``), and within it per further
    column of ``by``.  ``mode`` "dynamic" replaces the directories that ``df`` has rows for.

    Rows of one input file arrive in the same tasks (the FITS scan splits
    files, never mixes them), so each task writes one file per catalogue it
    holds; no shuffle is needed.
    """
    w = df.write.mode("overwrite" if mode == "dynamic" else mode).partitionBy(*by).option("compression", "zstd")
    if mode == "dynamic":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_combined(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: all rows, zstd, in the order of a space-filling curve, so that readers of a part of
    space skip row groups.  (A K1 output read as one table is the same rows.)"""
    rows = df.count()
    with scan_tasks(df.sparkSession, rows):
        curve_ordered(df, rows=rows).write.mode(mode).option("compression", "zstd").parquet(path)
