"""Summaries, dimension lookups, union, view."""

import pytest
from pyspark.sql import functions as F

from skycat.functions.catalog import quality_mask
from skycat.operators import summary, view
from skycat.operators.dims import color_points, tracer_dim, tracer_name
from skycat.operators.ingest import combine_catalogs, process_catalog


def _raw(spark, rows):
    return spark.createDataFrame(rows, "file_name string, RA double, DEC double, Z double, WEIGHT float, row_index bigint")


def test_catalog_summary_reports_empty_file(spark):
    rows = [
        ("LRG_N_clustering.dat.fits", 10.0, 5.0, 0.5, 1.0, 0),
        ("LRG_N_clustering.dat.fits", 11.0, 5.0, 0.9, 1.0, 1),
        ("QSO_S_clustering.dat.fits", 10.0, 5.0, 7.0, 1.0, 0),  # cut: z >= 5
    ]
    s = {r.catalog: r for r in summary.catalog_summary(_raw(spark, rows), keep=quality_mask()).collect()}
    assert s["LRG_N"].n_galaxies == 2 and s["LRG_N"].tracer == "LRG" and s["LRG_N"].z_range == "0.500–0.900"
    assert s["QSO_S"].n_galaxies == 0 and s["QSO_S"].z_min is None
    assert s["LRG_N"].output == "LRG_N_clustering.dat.parquet"


def test_process_catalog_schema_and_values(spark):
    rows = [("ELG_LOPnotqso_S_clustering.dat.fits", 0.0, 0.0, 1.0, 2.0, 7)]
    out = process_catalog(_raw(spark, rows), keep=("row_index",))
    assert out.dtypes == [
        ("ra", "float"), ("dec", "float"), ("z", "float"), ("x", "float"), ("y", "float"),
        ("z_cart", "float"), ("weight", "float"), ("tracer", "smallint"), ("catalog", "string"), ("row_index", "bigint"),
    ]
    r = out.first()
    assert r.tracer == 2 and r.catalog == "ELG_LOPnotqso_S"
    from skycat.functions.cosmology import comoving_distance_numpy

    assert r.x == pytest.approx(float(comoving_distance_numpy(1.0)[0]), rel=1e-6)
    assert abs(r.y) < 1e-3 and abs(r.z_cart) < 1e-3


def test_union_keeps_duplicates(spark):
    a = _raw(spark, [("BGS_BRIGHT_N_clustering.dat.fits", 1.0, 1.0, 0.1, 1.0, 0)])
    b = _raw(spark, [("BGS_BRIGHT-21.5_N_clustering.dat.fits", 1.0, 1.0, 0.1, 1.0, 0)])
    u = combine_catalogs(process_catalog(a), process_catalog(b))
    assert u.count() == 2 and {r.tracer for r in u.collect()} == {0}


def test_tracer_name_and_colour_defaults(spark):
    df = spark.createDataFrame([(1,), (9,)], "tracer short")
    names = [r.n for r in df.select(tracer_name("tracer").alias("n")).orderBy("tracer").collect()]
    assert names == ["LRG", "9"]
    c = {r.tracer: r for r in color_points(df).collect()}
    assert c[9].rgb == [1.0, 1.0, 1.0]
    assert c[1].rgb == pytest.approx([0.8, 0.133, 0.0])
    assert c[1].size == pytest.approx(1.5) and c[1].alpha == pytest.approx(0.7)


def test_tracer_dim(spark):
    d = {r.tracer: r for r in tracer_dim(spark).collect()}
    assert d[2].name == "ELG" and d[2].color == "#00CED1" and (d[2].z_min, d[2].z_max) == (0.8, 1.6) and d[2].target == 150000


def test_bounds_present_total_validate(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0, 0.5, 0, 1.0, 1.0, 1.0), (-1.0, 5.0, -3.0, 0.7, 1, -0.5, 1.0, 1.0), (0.0, 0.0, 0.0, 0.9, 1, 0.0, float("nan"), 1.0)],
        "x float, y float, z_cart float, z float, tracer short, weight float, ra float, dec float",
    )
    b = summary.bounds(df).first()
    assert (b.x_min, b.x_max, b.y_min, b.y_max, b.z_cart_min, b.z_cart_max) == (-1.0, 1.0, 0.0, 5.0, -3.0, 3.0)
    assert [r.tracer for r in summary.present_tracers(df).collect()] == [0, 1]
    assert summary.catalog_total(df).first().n_galaxies == 3
    v = {r.tracer: r for r in summary.validate_catalog(df).collect()}
    assert v[0].n_outside_range == 0 and v[1].n_outside_range == 0  # BGS 0.01-0.6, LRG 0.4-1.1
    assert v[1].n_nonfinite == 1 and v[1].n_nonpositive_weight == 2 and v[0].n_nonpositive_weight == 0


def test_style_and_visible_edges(spark):
    df = spark.createDataFrame([(0, 1.2), (0, 1.2000001), (0, 1.1999999), (3, 0.5), (9, 0.5)], "tracer short, z double")
    st = view.style_points(df, z_cutoff=1.2, hidden={3}).collect()
    assert [(r.size, r.alpha) for r in st][:4] == [(pytest.approx(1.5), pytest.approx(0.7)), (0.0, 0.0), (pytest.approx(1.5), pytest.approx(0.7)), (0.0, 0.0)]
    vis = view.visible_points(df, z_cutoff=1.2, hidden={3}).collect()
    assert sorted((r.tracer, r.z) for r in vis) == [(0, 1.1999999), (0, 1.2), (9, 0.5)]


def test_camera_defaults_and_limits():
    import math

    cam = view.orbit_camera()
    r = math.dist(cam.eye, (0, 0, 0))
    assert r == pytest.approx(4000.0)
    assert cam.back == pytest.approx(tuple(c / r for c in cam.eye))
    assert view.orbit_camera(radius=1e9).eye[1] == pytest.approx(20000 * math.sin(0.35 * math.pi))
    assert view.orbit_camera(phi=math.pi).eye[1] == pytest.approx(4000 * math.sin(math.pi / 2 - 0.001))


def test_projection_drops_and_image_sums(spark):
    cam = view.orbit_camera(theta=0.0, phi=0.0, radius=1000.0)  # eye (0, 0, 1000) looking down -z
    vp = view.Viewport(width=100, height=100)
    rows = [
        ("centre_a", 0.0, 0.0, -1000.0),  # depth 2000: on the optical axis
        ("centre_b", 0.0, 0.0, -1000.0),  # same pixel
        ("behind", 0.0, 0.0, 2000.0),
        ("too_near", 0.0, 0.0, 999.5),
        ("too_far", 0.0, 0.0, -60000.0),
        ("outside", 5000.0, 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "id string, x float, y float, z_cart float")
    proj = view.project_points(df, cam, vp)
    got = {r.id: r for r in proj.collect()}
    assert set(got) == {"centre_a", "centre_b"}
    assert (got["centre_a"].px, got["centre_a"].py) == (50, 50)
    assert got["centre_a"].size_px == pytest.approx(1.5 * 400 / 2000)
    pts = proj.withColumns({"rgb": F.array(F.lit(0.5), F.lit(0.25), F.lit(0.0)), "alpha": F.lit(0.7)})
    img = view.density_image(view.splat(pts, vp), vp).collect()
    assert len(img) == 1 and img[0].n_points == 2
    assert (img[0].r, img[0].g, img[0].b) == pytest.approx((0.7, 0.35, 0.0))


def test_splat_footprint_of_a_near_point(spark):
    cam = view.orbit_camera(theta=0.0, phi=0.0, radius=1000.0)
    vp = view.Viewport(width=200, height=200)
    df = spark.createDataFrame([(0.0, 0.0, 900.0)], "x float, y float, z_cart float")  # depth 100: size 6 px
    proj = view.project_points(df, cam, vp)
    sp = view.splat(proj, vp).collect()
    assert 20 <= len(sp) <= 36
    assert max(r.coverage for r in sp) == pytest.approx(1.0)
    assert all(0 < r.coverage <= 1 for r in sp)


def test_color_points_via_dimension_join_matches_inline(spark):
    df = spark.createDataFrame([(t,) for t in (0, 1, 2, 3, 9)], "tracer short")
    inline = sorted((r.tracer, tuple(r.rgb)) for r in color_points(df).collect())
    joined = sorted((r.tracer, tuple(r.rgb)) for r in color_points(df, tracer_dim(spark)).collect())
    assert inline == joined and inline[-1] == (9, (1.0, 1.0, 1.0))


def test_density_image_total_equals_visible_points(spark):
    from skycat.plans.queries import processed

    cat = processed(spark, "/root/testdata/sf0.001")
    cam = view.orbit_camera(radius=20_000.0)  # far: every footprint is one pixel
    vp = view.Viewport(width=640, height=360)
    img = view.render(cat, cam, vp, z_cutoff=1.2, hidden={3})
    vis = view.visible_points(cat, z_cutoff=1.2, hidden={3})
    proj = view.project_points(vis, cam, vp).where("px >= 0 AND px < 640 AND py >= 0 AND py < 360")
    assert proj.where("size_px > 1").count() == 0
    total = img.agg(F.sum("n_points")).first()[0]
    assert total == proj.count() > 0
    assert img.where("r > 1 OR g > 1 OR b > 1").count() == 0  # clamped


def test_dimension_broadcast_is_size_checked(spark):
    from skycat.operators.dims import bounded_broadcast

    small = spark.range(10)
    big = spark.range(1000)
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(bounded_broadcast(small)) and not hinted(bounded_broadcast(big))
