"""FITS catalogues -> processed Parquet (per catalogue) + summary.

    discover (S1) -> manifest check (S2) -> ledger (S2: what is there is skipped)
    -> FITS scan (S3) -> cut, distance, Cartesian, narrowing (P1-P7)
    -> Parquet by catalogue and input file (K1) -> summary (A1, A2)

The row work is one narrow projection per scan partition; there is no shuffle
before the write.

Ingest is incremental.  Every input file has a directory of its own
(``catalog=<label>/source=<key of its path>``), and a ledger beside them
(``_ledger``, hidden from readers of the catalogue) logs each file that was
processed: path, length, time, rows, range.  A run lists the folder, takes by
an anti join the files that the ledger does not know in this length and time,
removes the directories of files that have changed or gone, reads the new and
changed files alone, and appends to the ledger as its last act.  A run that dies before that
is repeated by the next one with the same result.  The summary comes from the
ledger: the catalogue is not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycat.functions.catalog import catalog_label, format_count, format_z_range, output_name, tracer_id
from skycat.operators.dims import manifest_df, tracer_name
from skycat.operators.ingest import process_catalog
from skycat.schema import CATALOG_GLOB, FITS_EXTENSION
from skycat.session import ensure_checkpoint_dir
from skycat.sources import catalog as cat
from skycat.sources.tables import delete_path, path_exists

LEDGER = "path string, length long, modified timestamp, file_name string, catalog string, source string, n_galaxies long, z_min float, z_max float, n_files long, gone boolean, run long"


@dataclass
class IngestResult:
    output: str
    files: DataFrame
    manifest: DataFrame
    summary: DataFrame
    total: int
    #: Input files that this run read.
    read: list[str]


def source_key(path: Column) -> Column:
    """The name of an input file's directory (with a letter first, so that no reader takes it for a number)."""
    return F.concat(F.lit("f"), F.substring(F.sha1(path), 1, 16))


def ledger_path(out_path: str) -> str:
    return f"{out_path.rstrip('/')}/_ledger"


def ledger(spark: SparkSession, out_path: str) -> DataFrame:
    """The files that the catalogue at ``out_path`` holds: the last entry of each path, unless it says gone."""
    if not path_exists(spark, ledger_path(out_path)):
        return spark.createDataFrame([], LEDGER)
    log = spark.read.schema(LEDGER).parquet(ledger_path(out_path))
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("run")))
    return log.withColumn("_nth", last).where("_nth = 1 AND NOT gone").drop("_nth")


def ingest(
    spark: SparkSession,
    raw_path: str,
    out_path: str,
    *,
    pattern: str = CATALOG_GLOB,
    extname: str = FITS_EXTENSION,
    rows_per_partition: int | None = None,
    id_from_path: bool | None = None,
    incremental: bool = True,
) -> IngestResult:
    """``id_from_path``: keep each row's file path next to its row index (the
    row identity); otherwise ``source``, the key of the path, stands for it.

    ``incremental`` False reads all files, whatever the ledger says.
    """
    ensure_checkpoint_dir(spark)
    # the listing is used several times: one row per file, kept in the checkpoint folder
    files = cat.discover_catalogs(spark, raw_path, pattern).checkpoint(eager=True)
    manifest = cat.manifest_status(manifest_df(spark), files)
    if not incremental:
        delete_path(spark, out_path)
    known = path_exists(spark, ledger_path(out_path))
    before = ledger(spark, out_path).checkpoint(eager=True) if known else ledger(spark, out_path)
    run = 1 + (before.agg(F.max("run")).first()[0] or 0) if known else 1
    same = ["path", "length", "modified"]
    new = files.join(before, same, "left_anti").checkpoint(eager=True) if known else files
    if known:  # directories of files that are no longer there, or no longer what they were
        for r in before.join(files, same, "left_anti").select("catalog", "source").toLocalIterator():
            delete_path(spark, f"{out_path.rstrip('/')}/catalog={r.catalog}/source={r.source}")
    listed = new.select("path", "length").orderBy("path").collect()
    paths = [r.path for r in listed]
    if paths:
        raw = cat.read_raw(
            spark, raw_path, extname=extname, pattern=pattern, rows_per_partition=rows_per_partition, include_path=True, files=paths, lengths=[r.length for r in listed]
        )
        keep = ("row_index", "path")
        rows = process_catalog(raw, keep=keep).withColumn("source", source_key(_listed(F.col("path"))))
        if not id_from_path:
            rows = rows.drop("path")
        cat.write_per_catalog(rows, out_path, "dynamic", ("catalog", "source"))
    metrics = file_metrics(spark, out_path, new) if paths else spark.createDataFrame([], LEDGER).drop("gone", "run")
    entries = metrics.withColumns({"gone": F.lit(False), "run": F.lit(run)})
    if known:
        dropped = before.join(files, "path", "left_anti").withColumns({"gone": F.lit(True), "run": F.lit(run)})
        entries = entries.unionByName(dropped)
    entries.write.mode("append").parquet(ledger_path(out_path))

    summary = file_summary(spark, out_path)
    total = int(summary.agg(F.sum("n_galaxies")).first()[0] or 0)
    return IngestResult(out_path, files, manifest, summary, total, paths)


def _listed(path: Column) -> Column:
    """A path as the listing spells it (the scan names local files without a scheme)."""
    return F.when(path.startswith("/"), F.concat(F.lit("file:"), path)).otherwise(path)


def file_metrics(spark: SparkSession, out_path: str, files: DataFrame) -> DataFrame:
    """A1 per input file: rows, redshift range and how many files were written, by one aggregation
    over the directories of ``files`` (path, length, modified, file_name)."""
    wanted = files.select("path", "length", "modified", "file_name", catalog_label("file_name").alias("catalog"), source_key(F.col("path")).alias("source"))
    # the join on the partition column prunes the scan to the directories of these files
    rows = spark.read.schema("z float, catalog string, source string").parquet(out_path)
    rows = rows.select("z", "source", F.col("_metadata.file_path").alias("file")).join(wanted.select("source"), "source", "left_semi")
    found = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_galaxies"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count_distinct("file").alias("n_files")
    )
    return wanted.join(found, "source", "left").fillna(0, ["n_galaxies", "n_files"]).select(*wanted.columns, "n_galaxies", "z_min", "z_max", "n_files")


def file_summary(spark: SparkSession, out_path: str) -> DataFrame:
    """A1: one row per input file, from the ledger; ``output`` is the directory that its rows are in."""
    root = out_path.rstrip("/")
    output = F.when(F.col("n_galaxies") > 0, F.concat(F.lit(f"{root}/catalog="), "catalog", F.lit("/source="), "source"))
    return (
        ledger(spark, out_path)
        .select(
            "path",
            "file_name",
            "catalog",
            tracer_name(tracer_id("file_name")).alias("tracer"),
            "n_galaxies",
            format_count("n_galaxies").alias("galaxies"),
            "z_min",
            "z_max",
            format_z_range("z_min", "z_max").alias("z_range"),
            output.alias("output"),
            "n_files",
        )
        .orderBy("catalog", "path")
    )


def by_catalog(summary: DataFrame) -> DataFrame:
    """A1 per catalogue name, as the original prints it where each name is one file."""
    sums = summary.groupBy("file_name").agg(F.sum("n_galaxies").alias("n_galaxies"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"))
    return sums.select(
        catalog_label("file_name").alias("catalog"),
        tracer_name(tracer_id("file_name")).alias("tracer"),
        "n_galaxies",
        format_count("n_galaxies").alias("galaxies"),
        "z_min",
        "z_max",
        format_z_range("z_min", "z_max").alias("z_range"),
        output_name("file_name").alias("output"),
    ).orderBy("catalog")
