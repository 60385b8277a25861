"""The physical plans we rely on at scale: pushdown, pruning, no needless shuffles."""

import os

import pytest
from pyspark.sql import functions as F

from skycat.operators import sampling, summary, view
from skycat.operators.ingest import process_catalog


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def catalog_path(spark, tmp_path_factory):
    from skycat.plans.queries import processed

    path = str(tmp_path_factory.mktemp("cat") / "c")
    processed(spark, "/root/testdata/sf0.001").write.parquet(path)
    return path


def test_visible_points_pushes_filters_and_prunes(spark, catalog_path):
    df = view.visible_points(spark.read.parquet(catalog_path).select("x", "tracer", "z"), z_cutoff=1.2, hidden={3})
    plan = _plan(df)
    # cast(z as double) <= 1.2 is unwrapped to z < 1.2f on the float column
    assert "LessThan(z,1.2)" in plan.split("PushedFilters")[1]
    assert "Not(EqualTo(tracer,3))" in plan.split("PushedFilters")[1]
    assert "ReadSchema: struct<z:float,x:float,tracer:smallint>" in plan


def test_ingest_has_no_shuffle(spark, tmp):
    import numpy as np

    from skycat.sources import catalog as cat
    from skycat.sources import fits

    fits.write_fits_table(os.path.join(tmp, "LRG_N_clustering.dat.fits"), {c: np.ones(10) for c in ("RA", "DEC", "Z")} | {"WEIGHT": np.ones(10, np.float32)})
    plan = _plan(process_catalog(cat.read_raw(spark, tmp)))
    assert "Exchange" not in plan and "BatchEvalPython" not in plan
    # the distance / Cartesian projection and the cut run inside whole-stage codegen
    codegen_lines = [line for line in plan.splitlines() if "*(" in line]
    assert any("Project" in line and "SQRT" in line for line in codegen_lines)
    assert any("Filter" in line for line in codegen_lines)


def test_density_image_is_partial_then_final_aggregate(spark, catalog_path):
    plan = _plan(view.render(spark.read.parquet(catalog_path)))
    assert plan.count("HashAggregate") == 2 and "Exchange hashpartitioning(px" in plan
    # points of one pixel go straight into the aggregate: only the branch of the large ones explodes
    small, large = plan[plan.index("Union") :].split("Generate", 1)
    assert plan.count("Union") == 1 and "FileScan parquet" in small and plan.count("FileScan parquet") == 2
    assert "Join" not in plan and "BroadcastExchange" not in plan  # palette is an inline lookup


def test_sampling_never_sorts_the_catalogue(spark, catalog_path):
    cat = spark.read.parquet(catalog_path)
    out = sampling.weighted_stratified_sample(cat, {0: 10, 1: 10, 2: 10, 3: 10}, id_cols=("catalog", "z", "x"))
    plan = _plan(out)
    # ranked rows come from the checkpointed order of the survivors: no scan, and no window over a stratum
    assert "Scan ExistingRDD" in plan and "FileScan parquet" not in plan
    assert not [line for line in plan.splitlines() if "Window" in line and "tracer" in line]


def test_union_of_all_catalogues_is_one_scan(spark):
    from skycat.plans.queries import QUERIES

    plan = _plan(QUERIES["combined_catalogs"](spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan and "PartitionFilters: []" in plan


def test_scene_is_one_pass_over_the_capped_points(spark):
    from skycat.plans.queries import QUERIES

    plan = _plan(QUERIES["scene_points"](spark, "/root/testdata/sf0.001"))
    assert "Union" not in plan and plan.count("Scan ExistingRDD") + plan.count("FileScan parquet") <= 2


def test_summary_aggregates_are_partial(spark, catalog_path):
    plan = _plan(summary.validate_catalog(spark.read.parquet(catalog_path)))
    assert "partial_count" in plan and "BroadcastExchange" in plan


def test_near_view_reads_a_part_of_the_ordered_table(spark, tmp):
    """The frustum's box is pushed into the scan, and in curve order it rules out most files' row groups."""
    import glob

    import pyarrow.parquet as pq

    from skycat.plans.queries import NEAR_CAMERA, NEAR_VIEWPORT, processed
    from skycat.sources.catalog import write_combined

    rows = processed(spark, "/root/testdata/sf0.01")
    path = os.path.join(tmp, "ordered")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        write_combined(rows, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    near = view.project_points(spark.read.parquet(path).select("id", "x", "y", "z_cart"), NEAR_CAMERA, NEAR_VIEWPORT)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        pushed = _plan(view.project_points(spark.read.parquet(path).select("id", "x", "y", "z_cart"), NEAR_CAMERA, NEAR_VIEWPORT)).split("PushedFilters")[1].splitlines()[0]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f"{op}({c}," in pushed for c in ("x", "y", "z_cart") for op in ("GreaterThanOrEqual", "LessThanOrEqual"))
    bounds = dict(zip(("x", "y", "z_cart"), view.frustum_bounds(NEAR_CAMERA, NEAR_VIEWPORT)))
    groups = read = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k).statistics for k in range(meta.num_columns)}
            groups += 1
            read += all(stats[c].max >= low and stats[c].min <= high for c, (low, high) in bounds.items())
    assert groups >= 64 and read < groups / 3
    # the same rows as without the box
    free = view.frustum_bounds
    try:
        view.frustum_bounds = lambda *a: [(-3e38, 3e38)] * 3
        whole = view.project_points(rows.select("id", "x", "y", "z_cart"), NEAR_CAMERA, NEAR_VIEWPORT)
    finally:
        view.frustum_bounds = free
    assert sorted(near.collect()) == sorted(whole.collect()) and near.count() > 50


def test_no_single_task_above_the_export_order(spark):
    """The parts of the export's order are written by their own tasks."""
    import inspect

    from skycat.sources import packed

    assert "coalesce" not in inspect.getsource(packed)


def test_image_is_the_same_to_the_last_bit_on_any_partitioning(spark):
    pts = spark.range(20000).select((F.col("id") % 7).cast("int").alias("px"), F.lit(0).alias("py"), (1.0 / (F.col("id") + 3)).alias("coverage"),
                                    F.lit(1e-4).alias("alpha"), F.array(F.lit(0.3), F.lit(0.7), F.lit(1.0)).alias("rgb"))
    images = [sorted(view.density_image(d).collect()) for d in (pts.coalesce(1), pts.repartition(13), pts.orderBy(F.desc("id")))]
    assert images[0] == images[1] == images[2] and 0 < images[0][0].r < 1
    bright = pts.select("px", "py", F.lit(1.0).alias("coverage"), F.lit(3e9).alias("alpha"), "rgb")
    assert {(r.r, r.g, r.b) for r in view.density_image(bright).collect()} == {(1.0, 1.0, 1.0)}


def test_a_larger_catalogue_is_sorted_by_more_tasks_and_shuffled_without_keys(spark, monkeypatch):
    from skycat.operators import layout

    monkeypatch.setattr(layout, "TASK_ROWS", 100, raising=False)
    rows = spark.range(5000).selectExpr(
        "id", "cast(id % 17 * 300 as float) x", "cast(id % 29 * 200 as float) y", "if(id % 7 = 0, null, cast(id as float)) z_cart"
    )
    ordered = layout.curve_ordered(rows)
    assert ordered.rdd.getNumPartitions() >= 50
    assert layout.curve_ordered(rows, rows=20_000).rdd.getNumPartitions() >= 200
    assert layout.curve_ordered(rows, partitions=3).rdd.getNumPartitions() == 3
    exchange = ordered._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "AS _curve" not in exchange and "AS _fine" not in exchange
    assert ordered.columns == rows.columns
    assert sorted(r["id"] for r in ordered.collect()) == list(range(5000))
    keys = [r[0] for r in ordered.select(layout.curve_key()).collect() if r[0] is not None]
    assert keys == sorted(keys)


def test_a_derived_table_is_read_by_tasks_of_bounded_rows(spark, tmp, monkeypatch):
    from skycat.sources import tables

    name = "spark.sql.files.minPartitionNum"
    monkeypatch.setattr(tables, "SCAN_ROWS", 100, raising=False)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        spark.range(20_000).coalesce(1).write.option("parquet.block.size", 1024).parquet(tmp + "/in")

        def rows():
            return spark.read.parquet(tmp + "/in")

        plain = rows().rdd.getNumPartitions()
        with tables.scan_tasks(spark, 20_000):
            assert rows().rdd.getNumPartitions() >= 200 > plain
        with tables.scan_tasks(spark, 10):
            assert spark.conf.get(name, None) is None
        copy = tables.materialized(spark, tmp, rows, rows=lambda: 20_000)
        assert len(copy.inputFiles()) > plain
        assert copy.count() == copy.distinct().count() == 20_000
        assert spark.conf.get(name, None) is None
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
