"""Unit tests of the column expressions (FIXTURES §3, §4)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycat.functions.catalog import catalog_label, decode_z, encode_z, format_count, format_z_range, output_name, quality_mask, tracer_id
from skycat.functions.coords import scale_coords, sky_to_cartesian
from skycat.functions.cosmology import comoving_distance, comoving_distance_numpy
from skycat.functions.hashing import identity, uniform

# FIXTURES §4: Mpc from the formula (200-node quadrature), H0 67.4, Om0 0.315
ANCHORS = {
    0.001: 4.446908, 0.01: 44.374309, 0.1: 434.110995, 0.3: 1236.444293, 0.4: 1604.583728,
    0.6: 2277.745889, 0.7: 2584.731800, 1.1: 3642.576861, 1.5: 4482.096986, 1.6: 4665.121252,
    2.1: 5455.485149, 5.0: 7946.006818,
}


def test_comoving_distance_anchors(spark):
    df = spark.createDataFrame([(z,) for z in ANCHORS], "z double")
    got = {r.z: r.d for r in df.select("z", comoving_distance("z").alias("d")).collect()}
    for z, mpc in ANCHORS.items():
        assert got[z] == pytest.approx(mpc, abs=2e-6), z


def test_comoving_distance_matches_independent_quadrature(spark):
    zs = np.concatenate([np.geomspace(0.001, 5.0, 300), [0.0011, 4.999]])
    df = spark.createDataFrame([(float(z),) for z in zs], "z double")
    got = np.array([r.d for r in df.select(comoving_distance("z").alias("d")).collect()])
    ref = comoving_distance_numpy(zs)
    assert np.max(np.abs(got / ref - 1)) < 1e-12


def test_tracer_id_prefixes(spark):
    names = ["BGS_BRIGHT-21.5_N_clustering.dat.fits", "BGS_BRIGHT_S_x", "LRG_N_x", "ELG_LOPnotqso_S_x", "QSO_N_x", "ELG_other_x", ""]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r.t for r in df.select(tracer_id("f").alias("t")).collect()] == [0, 0, 1, 2, 3, 0, 0]
    assert dict(df.dtypes)["f"] == "string"
    assert df.select(tracer_id("f").alias("t")).dtypes == [("t", "smallint")]


def test_catalog_label_and_output_name(spark):
    df = spark.createDataFrame([("LRG_N_clustering.dat.fits",)], "f string")
    r = df.select(catalog_label("f").alias("c"), output_name("f").alias("o")).first()
    assert r.c == "LRG_N" and r.o == "LRG_N_clustering.dat.parquet"


def test_quality_cut_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (10.0, 10.0, 0.001), (10.0, 10.0, 0.0010001), (10.0, 10.0, 4.999), (10.0, 10.0, 5.0),
        (10.0, 10.0, nan), (10.0, 10.0, inf), (10.0, 10.0, -inf), (nan, 10.0, 1.0), (10.0, -inf, 1.0),
    ]
    rows = [r + (1.0,) for r in rows] + [(10.0, 10.0, 2.0, nan)]  # the weight is not checked
    df = spark.createDataFrame(rows, "RA double, DEC double, Z double, WEIGHT float")
    kept = sorted(r.Z for r in df.where(quality_mask()).collect())
    assert kept == [0.0010001, 2.0, 4.999]


def test_sky_to_cartesian(spark):
    rows = [(0.0, 0.0, 1.0), (90.0, 0.0, 1.0), (0.0, 90.0, 1.0), (180.0, -90.0, 2.0)]
    df = spark.createDataFrame(rows, "ra double, dec double, d double")
    x, y, z = sky_to_cartesian("ra", "dec", "d")
    got = [(r.x, r.y, r.z) for r in df.select(x.alias("x"), y.alias("y"), z.alias("z")).collect()]
    want = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, -2)]
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=1e-6)


def test_scale_coords(spark):
    df = spark.createDataFrame([(1000.0, -2000.0, 3000.0)], "x float, y float, z_cart float")
    r = scale_coords(df, 0.001).first()
    assert (r.x, r.y, r.z_cart) == pytest.approx((1.0, -2.0, 3.0))


def test_encode_decode_z(spark):
    zs = [0.0, 0.00009, 0.5, 6.5535, 7.0, -1.0]
    df = spark.createDataFrame([(z,) for z in zs], "z float")
    enc = [r.q for r in df.select(encode_z("z").alias("q")).collect()]
    assert enc[:3] == [0, 0, 5000] and enc[4:] == [65535, 0]
    assert abs(enc[3] - 65535) <= 1  # f32 product
    assert df.select(encode_z("z").alias("q")).dtypes == [("q", "int")]
    dec = spark.createDataFrame([(5000,)], "q int").select(decode_z("q").alias("z")).first().z
    assert dec == pytest.approx(0.5)


def test_formatting(spark):
    df = spark.createDataFrame([(1234567, 0.0123, 0.5984)], "n bigint, a float, b float")
    r = df.select(format_count("n").alias("n"), format_z_range("a", "b").alias("r")).first()
    assert r.n == "1,234,567" and r.r == "0.012–0.598"


def test_uniform_is_deterministic_and_in_range(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    u1 = [r.u for r in df.select(uniform("s", identity("k")).alias("u")).collect()]
    u2 = [r.u for r in df.repartition(7).orderBy("k").select(uniform("s", identity("k")).alias("u")).collect()]
    assert all(0 < u < 1 for u in u1)
    assert sorted(u1) == sorted(u2)
    assert abs(np.mean(u1) - 0.5) < 0.03
    assert not math.isclose(u1[0], u1[1])


def test_properties_over_random_rows(spark):
    """|(x, y, z_cart)| equals the distance; decode(encode(z)) is within one quantum."""
    rng = np.random.default_rng(11)
    n = 20000
    rows = list(zip(rng.uniform(0, 360, n).tolist(), rng.uniform(-90, 90, n).tolist(), rng.uniform(0.0011, 4.99, n).tolist()))
    df = spark.createDataFrame(rows, "ra double, dec double, z double").withColumn("d", comoving_distance("z"))
    x, y, zc = sky_to_cartesian("ra", "dec", "d")
    out = df.select(
        (F.sqrt(x * x + y * y + zc * zc) / F.col("d") - 1).alias("rel"),
        (decode_z(encode_z("z")) - F.col("z").cast("float")).alias("dz"),
        encode_z("z").alias("q"),
    ).toPandas()
    assert out.rel.abs().max() < 1e-12
    sat = out.q == 65535
    assert (out.dz[~sat] <= 1e-6).all() and (out.dz[~sat] > -1.0001e-4).all()


def test_checkpoint_dir_policy():
    """A cluster session without spark.checkpoint.dir is refused; a configured
    folder is used as is; only a local session gets a folder of its own."""
    from skycat.session import ensure_checkpoint_dir

    class Conf:
        def __init__(self, d):
            self.d = d

        def get(self, key, default=None):
            return self.d if key == "spark.checkpoint.dir" else default

    class Ctx:
        def __init__(self, master, d=None):
            self.master, self.d = master, d

        def getCheckpointDir(self):
            return self.d

        def setCheckpointDir(self, d):
            self.d = d

    class Session:
        def __init__(self, master, conf_dir=None, ctx_dir=None):
            self.sparkContext, self.conf = Ctx(master, ctx_dir), Conf(conf_dir)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session("yarn"))
    assert ensure_checkpoint_dir(Session("yarn", ctx_dir="hdfs://nn/ckpt/app")) == "hdfs://nn/ckpt/app"
    assert ensure_checkpoint_dir(Session("k8s://x", conf_dir="s3a://b/ckpt")) == "s3a://b/ckpt"
    assert ensure_checkpoint_dir(Session("local[2]")).startswith(__import__("tempfile").gettempdir())
