"""Command line: the pipeline steps as Spark jobs.

    python -m skycat process  RAW_DIR PROCESSED        # E1: FITS -> Parquet per catalogue
    python -m skycat export   PROCESSED WEB_DIR        # E2: sample -> galaxies.bin + metadata.json
    python -m skycat scene    PROCESSED OUT [--max-points N]   # E4: capped, scaled, per tracer
    python -m skycat render   PROCESSED OUT [--width W --height H]  # E3: density image (Parquet)
    python -m skycat validate PROCESSED                # V1

Run under ``spark-submit`` to use a cluster; plain ``python -m`` starts a local
session.  Rows are identified by (catalog, row_index), or by (path, row_index)
when ``process`` found one catalogue name in several files.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from skycat.schema import SCENE_MAX_POINTS_CLI, SCENE_SCALE


def _session() -> SparkSession:
    builder = SparkSession.builder.appName("skycat")
    if not _submitted():  # spark-submit supplies the master
        builder = builder.master("local[*]").config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    from skycat.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return spark


def _submitted() -> bool:
    import os

    return "PYSPARK_GATEWAY_PORT" in os.environ  # set when spark-submit launched us


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m skycat", description=__doc__.splitlines()[0])
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("process", help="FITS catalogues -> processed Parquet")
    p.add_argument("raw")
    p.add_argument("processed")
    p.add_argument("--require-manifest", action="store_true", help="exit with 1 if a catalogue of the manifest is missing")
    p.add_argument("--combined", metavar="PATH", help="also write all rows as one table, ordered by position")
    p.add_argument("--all", action="store_true", help="read all files, also those of earlier runs")
    e = sub.add_parser("export", help="processed catalogue -> packed sample + metadata")
    e.add_argument("processed")
    e.add_argument("web")
    s = sub.add_parser("scene", help="capped, scaled points per tracer")
    s.add_argument("processed")
    s.add_argument("out")
    s.add_argument("--max-points", type=int, default=SCENE_MAX_POINTS_CLI)
    s.add_argument("--scale", type=float, default=SCENE_SCALE)
    r = sub.add_parser("render", help="density image of the catalogue")
    r.add_argument("processed")
    r.add_argument("out")
    r.add_argument("--width", type=int, default=1920)
    r.add_argument("--height", type=int, default=1080)
    v = sub.add_parser("validate", help="per-tracer validation counts")
    v.add_argument("processed")
    args = ap.parse_args(argv)

    spark = _session()
    failed = False
    if args.cmd == "process":
        from skycat.plans.ingest import by_catalog, ingest

        res = ingest(spark, args.raw, args.processed, incremental=not args.all)
        by_catalog(res.summary).show(100, truncate=False)
        missing = [row.file_name for row in res.manifest.collect() if not row.present]
        if missing:
            print(f"missing from the manifest: {len(missing)}: {', '.join(sorted(missing))}")
            failed = args.require_manifest
        print(f"files read: {len(res.read)}; skipped: {res.files.count() - len(res.read)}")
        if args.combined:
            from skycat.sources.catalog import read_catalog, write_combined

            write_combined(read_catalog(spark, res.output), args.combined)
        print(f"combined catalogue: {res.total:,} galaxies -> {res.output}")
    elif args.cmd == "export":
        from skycat.plans.export import export_web
        from skycat.sources.catalog import identity_columns, read_catalog

        cat = read_catalog(spark, args.processed, with_identity=True)
        res = export_web(cat, args.web, id_cols=identity_columns(cat))
        res.sample_summary.orderBy("tracer").show()
        print(f"wrote {res.metadata['n_points']:,} points -> {res.binary}")
    elif args.cmd == "scene":
        from skycat.plans.scene import scene_points, write_scene
        from skycat.sources.catalog import identity_columns, read_catalog

        ids = identity_columns(read_catalog(spark, args.processed, with_identity=True))
        pts = scene_points(spark, args.processed, max_points=args.max_points, scale=args.scale, id_cols=ids)
        write_scene(pts, args.out)
        print(f"scene points -> {args.out}")
    elif args.cmd == "render":
        from skycat.operators.view import Viewport, render
        from skycat.sources.catalog import read_catalog

        img = render(read_catalog(spark, args.processed), viewport=Viewport(args.width, args.height))
        img.write.mode("overwrite").parquet(args.out)
        print(f"density image -> {args.out}")
    elif args.cmd == "validate":
        from skycat.operators.summary import validate_catalog
        from skycat.sources.catalog import read_catalog

        validate_catalog(read_catalog(spark, args.processed)).orderBy("tracer").show()
    spark.stop()
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
