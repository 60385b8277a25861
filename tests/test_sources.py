"""Round trips and guards of the sources and sinks."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycat.sources import catalog as cat
from skycat.sources import fits, packed
from skycat.operators.dims import manifest_df


def _points(spark, n=1000):
    rows = [(float(i), float(-i), float(i) / 3, i % 4, (i % 300) / 100.0) for i in range(n)]
    return spark.createDataFrame(rows, "x float, y float, z_cart float, tracer short, z float")


def test_packed_single_file_is_byte_exact(spark, tmp):
    df = _points(spark, 10)
    path = os.path.join(tmp, "g.bin")
    packed.write_packed(df, path)
    raw = open(path, "rb").read()
    assert len(raw) == 16 + 16 * 10
    assert struct.unpack("<IIII", raw[:16]) == (0x44455349, 1, 10, 0)
    x, y, zc, t, res, q = struct.unpack("<fffBBH", raw[16 + 16 * 3 : 16 + 16 * 4])
    assert (x, y, zc, t, res, q) == (3.0, -3.0, pytest.approx(1.0), 3, 0, 300)


def test_packed_round_trip_single_and_parts(spark, tmp):
    df = _points(spark)
    one = os.path.join(tmp, "one.bin")
    parts = os.path.join(tmp, "parts")
    packed.write_packed(df, one)
    packed.write_packed(df.repartition(4), parts, single_file=False)
    assert len([f for f in os.listdir(parts) if f.endswith(".galbin")]) == 4
    a = packed.read_packed(spark, one, records_per_partition=77)
    b = packed.read_packed(spark, parts)
    assert a.rdd.getNumPartitions() == 13
    want = sorted((r.x, r.tracer) for r in df.collect())
    assert sorted((r.x, r.tracer) for r in a.collect()) == want == sorted((r.x, r.tracer) for r in b.collect())
    z = {r.x: r.z for r in a.collect()}
    assert z[250.0] == pytest.approx(2.5, abs=1e-4)
    # order is kept in the single file
    assert [r.x for r in a.orderBy(F.monotonically_increasing_id()).collect()][:5] == [0.0, 1.0, 2.0, 3.0, 4.0]


@pytest.mark.parametrize(
    "header,body,msg",
    [
        ((0x12345678, 1, 0, 0), b"", "magic"),
        ((0x44455349, 2, 0, 0), b"", "version"),
        ((0x44455349, 1, 3, 0), b"\0" * 32, "truncated"),
    ],
)
def test_packed_guards(spark, tmp, header, body, msg):
    path = os.path.join(tmp, "bad.bin")
    with open(path, "wb") as f:
        f.write(struct.pack("<IIII", *header) + body)
    with pytest.raises(Exception, match=msg):
        packed.read_packed(spark, path).collect()


def test_packed_empty(spark, tmp):
    path = os.path.join(tmp, "empty.bin")
    with open(path, "wb") as f:
        f.write(struct.pack("<IIII", 0x44455349, 1, 0, 0))
    assert packed.read_packed(spark, path).count() == 0


def test_packed_range_checks(spark, tmp):
    bad = spark.createDataFrame([(0.0, 0.0, 0.0, 300, 0.5)], "x float, y float, z_cart float, tracer short, z float")
    with pytest.raises(Exception, match="tracer"):
        packed.write_packed(bad, os.path.join(tmp, "t.bin"))
    assert not [f for f in os.listdir(tmp) if f.endswith(".tmp")]  # failed attempts leave nothing
    assert not os.path.exists(os.path.join(tmp, "t.bin"))


def test_metadata_round_trip(spark, tmp):
    df = _points(spark, 50)
    doc = packed.metadata_document(df)
    path = os.path.join(tmp, "metadata.json")
    packed.write_metadata(doc, path)
    text = open(path).read()
    assert text.startswith("{\n  \"version\": 1,")
    assert json.loads(text)["bounds"]["x"] == [0.0, 49.0]
    m = packed.read_metadata(spark, path).first()
    assert m.n_points == 50 and m.tracers["3"].name == "QSO" and m.tracers["0"].z_range == [0.01, 0.6]
    assert m.cosmology.model == "FlatLambdaCDM" and m.bounds.z == [0.0, pytest.approx(49 / 3)]


def _fits_cols(n, seed=0):
    rng = np.random.default_rng(seed)
    return {
        "TARGETID": np.arange(n, dtype=np.int64),  # a column before RA
        "RA": rng.uniform(0, 360, n),
        "DEC": rng.uniform(-90, 90, n),
        "Z": rng.uniform(0, 3, n),
        "WEIGHT": rng.uniform(0, 2, n).astype(np.float32),
    }


def test_fits_one_and_many_partitions_agree(spark, tmp):
    n = 500  # 36-byte rows: the table crosses several 2,880-byte blocks
    cols = _fits_cols(n)
    other = fits.bintable_bytes({"A": np.arange(5.0)}, extname="OTHER")
    fits.write_fits_table(os.path.join(tmp, "LRG_N_clustering.dat.fits"), cols, before=[other])
    one = cat.read_raw(spark, tmp)
    many = cat.read_raw(spark, tmp, rows_per_partition=33)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 16
    a = sorted(one.collect(), key=lambda r: r.row_index)
    b = sorted(many.collect(), key=lambda r: r.row_index)
    assert a == b and len(a) == n
    assert [r.RA for r in a] == list(cols["RA"]) and [r.WEIGHT for r in a] == list(cols["WEIGHT"])
    assert a[0].file_name == "LRG_N_clustering.dat.fits"


def test_fits_scaled_and_unsigned_columns(tmp):
    info_path = os.path.join(tmp, "t.fits")
    fits.write_fits_table(info_path, {"V": np.array([1, 2, 3], dtype=np.int16)})
    raw = bytearray(open(info_path, "rb").read())
    # add TZERO1 = 32768 (unsigned 16-bit convention) by rewriting the EXTNAME card slot
    text = raw.decode("latin1")
    i = text.index("EXTNAME ", 2880)
    card = "TZERO1  = " + f"{32768:>20}"
    raw[i : i + 80] = card.ljust(80).encode()
    j = text.index("END" + " " * 77, i)
    raw[j : j + 80] = ("EXTNAME = 'LSS     '".ljust(80)).encode()
    k = j + 80
    raw[k : k + 80] = ("END".ljust(80)).encode()
    open(info_path, "wb").write(bytes(raw))
    info = fits.scan_table(info_path)
    assert info.column("V").spark_type == "int"


def test_fits_missing_extension(tmp):
    path = os.path.join(tmp, "x.fits")
    fits.write_fits_table(path, {"RA": np.arange(3.0)}, extname="OTHER")
    with pytest.raises(ValueError, match="LSS"):
        fits.scan_table(path)


def test_discovery_and_manifest(spark, tmp):
    for name in ["LRG_N_clustering.dat.fits", "QSO_S_clustering.dat.fits", "notes.txt"]:
        open(os.path.join(tmp, name), "wb").write(b"x")
    found = cat.discover_catalogs(spark, tmp)
    assert [r.file_name for r in found.collect()] == ["LRG_N_clustering.dat.fits", "QSO_S_clustering.dat.fits"]
    st = {r.file_name: r.present for r in cat.manifest_status(manifest_df(spark), found).collect()}
    assert len(st) == 10 and st["LRG_N_clustering.dat.fits"] and not st["LRG_S_clustering.dat.fits"]
    assert cat.missing_catalogs(manifest_df(spark), found).count() == 8
    with pytest.raises(FileNotFoundError):
        cat.discover_catalogs(spark, os.path.join(tmp, "nothing-here-*"))


def test_read_catalog_requires_table(spark, tmp):
    with pytest.raises(FileNotFoundError):
        cat.read_catalog(spark, os.path.join(tmp, "absent"))


def _card(k, v):
    return fits._card(k, v)


def test_fits_all_scalar_formats(spark, tmp):
    """L, B, I, J, K, E, D, fixed A, a bit column X and a skipped P column, TSCAL/TZERO."""
    n = 3
    dt = np.dtype([
        ("L", "S1"), ("B", "u1"), ("I", ">i2"), ("J", ">i4"), ("K", ">i8"), ("E", ">f4"), ("D", ">f8"),
        ("A", "S5"), ("X", "u1"), ("P", ">i4", (2,)), ("S", ">i2"),
    ])
    rows = np.zeros(n, dtype=dt)
    rows["L"] = [b"T", b"F", b"T"]
    rows["B"] = [0, 200, 255]
    rows["I"] = [-5, 0, 7]
    rows["J"] = [1, -2, 3]
    rows["K"] = [10**12, -1, 0]
    rows["E"] = [1.5, 2.5, -3.5]
    rows["D"] = [0.1, 0.2, 0.3]
    rows["A"] = [b"ab", b"cde  ", b"x"]
    rows["S"] = [1, 2, 3]
    forms = [("L", "1L"), ("B", "1B"), ("I", "1I"), ("J", "1J"), ("K", "1K"), ("E", "1E"), ("D", "1D"),
             ("A", "5A"), ("X", "3X"), ("P", "1PE(4)"), ("S", "1I")]
    cards = [_card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", dt.itemsize),
             _card("NAXIS2", n), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(forms))]
    for i, (name, form) in enumerate(forms, 1):
        cards += [_card(f"TTYPE{i}", name), _card(f"TFORM{i}", form)]
    cards += [_card("TSCAL11", 0.5), _card("TZERO11", 10.0), _card("EXTNAME", "LSS")]
    body = rows.tobytes()
    path = os.path.join(tmp, "QSO_N_clustering.dat.fits")
    with open(path, "wb") as f:
        f.write(fits.primary_hdu() + fits._header(cards) + body + b"\0" * ((-len(body)) % 2880))
    fits.register(spark)
    df = spark.read.format("fits_table").load(tmp)
    types = dict(df.dtypes)
    assert types["L"] == "boolean" and types["B"] == "smallint" and types["K"] == "bigint" and types["A"] == "string"
    assert types["S"] == "double" and "X" not in types and "P" not in types
    got = sorted(df.collect(), key=lambda r: r.row_index)
    assert [r.L for r in got] == [True, False, True]
    assert [r.B for r in got] == [0, 200, 255] and [r.K for r in got] == [10**12, -1, 0]
    assert [r.A for r in got] == ["ab", "cde", "x"] and [r.S for r in got] == [10.5, 11.0, 11.5]
    assert [r.E for r in got] == [1.5, 2.5, -3.5] and [r.D for r in got] == [0.1, 0.2, 0.3]
    with pytest.raises(Exception, match="only scalar"):
        spark.read.format("fits_table").option("columns", "P").load(tmp).collect()


def test_fits_small_batches(spark, tmp):
    cols = _fits_cols(1000, seed=5)
    fits.write_fits_table(os.path.join(tmp, "ELG_LOPnotqso_S_clustering.dat.fits"), cols)
    fits.register(spark)
    df = spark.read.format("fits_table").option("columns", "RA,Z").option("batchBytes", "1000").load(tmp)
    got = sorted(df.collect(), key=lambda r: r.row_index)
    assert [r.row_index for r in got] == list(range(1000)) and [r.Z for r in got] == list(cols["Z"])


def test_fits_small_files_are_packed(spark, tmp):
    for i in range(40):
        fits.write_fits_table(os.path.join(tmp, f"part-{i:02d}", "LRG_S_clustering.dat.fits"), _fits_cols(50, seed=i))
    df = cat.read_raw(spark, tmp, include_path=True)
    n = df.rdd.getNumPartitions()
    assert 1 < n <= spark.sparkContext.defaultParallelism + 1
    assert df.count() == 2000 and df.select("path", "row_index").distinct().count() == 2000


def test_fits_header_quirks(spark, tmp):
    """Lowercase names, D exponents, comments, quotes, COMMENT/HISTORY cards and a
    header longer than one 2,880-byte block."""
    n = 7
    rows = np.zeros(n, dtype=[("ra", ">f8"), ("dec", ">f8"), ("z", ">f4"), ("w", ">f4")])
    rows["ra"] = np.arange(n) * 10.0
    rows["dec"] = np.arange(n) - 3.0
    rows["z"] = np.linspace(0.1, 0.7, n)
    rows["w"] = 2.0

    def card(text):
        return text.ljust(80)[:80].encode("ascii")

    cards = [
        card("XTENSION= 'BINTABLE'           / binary table extension"),
        card("BITPIX  =                    8 / array data type"),
        card("NAXIS   =                    2"),
        card(f"NAXIS1  =                   {rows.dtype.itemsize} / row width"),
        card(f"NAXIS2  =                    {n}"),
        card("PCOUNT  =                    0"),
        card("GCOUNT  =                    1"),
        card("TFIELDS =                    4"),
        card("TTYPE1  = 'ra      '"), card("TFORM1  = 'D       '"),
        card("TTYPE2  = 'dec'"), card("TFORM2  = '1D'"),
        card("TTYPE3  = 'z'"), card("TFORM3  = 'E'"),
        card("TTYPE4  = 'WEIGHT'"), card("TFORM4  = 'E'"), card("TSCAL4  =                0.5D0 / halves"),
        card("OBSERVER= 'O''Brien'           / embedded quote"),
    ]
    cards += [card(f"COMMENT padding card number {i}") for i in range(30)]
    cards += [card("HISTORY written by hand"), card("EXTNAME = 'lss'")]
    header = b"".join(cards) + card("END")
    header += b" " * ((-len(header)) % 2880)
    assert len(header) == 2 * 2880
    body = rows.tobytes()
    path = os.path.join(tmp, "BGS_BRIGHT_N_clustering.dat.fits")
    with open(path, "wb") as f:
        f.write(fits.primary_hdu() + header + body + b"\0" * ((-len(body)) % 2880))
    info = fits.scan_table(path)
    assert info.n_rows == n and info.column("RA").code == "D" and info.column("WEIGHT").scale == 0.5
    df = cat.read_raw(spark, tmp)
    got = sorted(df.collect(), key=lambda r: r.row_index)
    assert [r.RA for r in got] == list(rows["ra"]) and [r.DEC for r in got] == list(rows["dec"])
    assert [r.WEIGHT for r in got] == [1.0] * n  # 2.0 * TSCAL 0.5
    assert [r.Z for r in got] == [float(v) for v in rows["z"]]


def test_foreign_catalogue_gets_a_stable_identity(spark, tmp):
    """A catalogue in the original's layout (uint8 tracer, no provenance
    columns) reads with tracer as short and samples reproducibly."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from skycat.operators import sampling

    rng = np.random.default_rng(9)
    n = 3000
    t = pa.table({
        "ra": rng.uniform(0, 360, n).astype(np.float32), "dec": rng.uniform(-90, 90, n).astype(np.float32),
        "z": rng.uniform(0.01, 2, n).astype(np.float32), "x": rng.normal(size=n).astype(np.float32),
        "y": rng.normal(size=n).astype(np.float32), "z_cart": rng.normal(size=n).astype(np.float32),
        "weight": rng.uniform(0.5, 1.5, n).astype(np.float32), "tracer": pa.array(rng.integers(0, 4, n).astype(np.uint8)),
    })
    path = os.path.join(tmp, "all_galaxies.parquet")
    pq.write_table(t, path, compression="zstd", row_group_size=500)
    df = cat.read_catalog(spark, path, with_identity=True)
    assert dict(df.dtypes)["tracer"] == "smallint" and cat.identity_columns(df) == ("path", "row_index")
    a = sampling.weighted_stratified_sample(df, {0: 50, 1: 50}, id_cols=cat.identity_columns(df))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # split the file differently
    try:
        b = sampling.weighted_stratified_sample(cat.read_catalog(spark, path, with_identity=True), {0: 50, 1: 50}, id_cols=("path", "row_index"))
        assert sorted(r.row_index for r in a.collect()) == sorted(r.row_index for r in b.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_packed_write_of_empty_frame(spark, tmp):
    empty = _points(spark, 10).where("x < 0")
    path = os.path.join(tmp, "empty.bin")
    packed.write_packed(empty, path)
    assert open(path, "rb").read() == struct.pack("<IIII", 0x44455349, 1, 0, 0)
    assert packed.read_packed(spark, path).count() == 0


def test_packed_uri_paths(spark, tmp):
    """file:// URIs give the same files as local paths."""
    df = _points(spark, 300)
    a = os.path.join(tmp, "a.bin")
    b = "file://" + os.path.join(tmp, "b.bin")
    packed.write_packed(df, a)
    packed.write_packed(df, b)
    assert open(a, "rb").read() == open(os.path.join(tmp, "b.bin"), "rb").read()
    parts = "file://" + os.path.join(tmp, "parts")
    packed.write_packed(df.repartition(3), parts, single_file=False)
    assert packed.read_packed(spark, parts).count() == 300
    assert not [f for f in os.listdir(os.path.join(tmp, "parts")) if f.endswith(".tmp")]


def test_fits_through_uri(spark, tmp):
    cols = _fits_cols(100, seed=21)
    fits.write_fits_table(os.path.join(tmp, "sub", "QSO_N_clustering.dat.fits"), cols)
    df = cat.read_raw(spark, "file://" + tmp)
    got = sorted(df.collect(), key=lambda r: r.row_index)
    assert [r.RA for r in got] == list(cols["RA"]) and got[0].file_name == "QSO_N_clustering.dat.fits"


def test_write_per_catalog_and_combined(spark, tmp):
    """K1 (one directory per catalogue) and K2 (one table), both zstd; both read
    back (S4) as the same rows."""
    import glob as _glob

    import pyarrow.parquet as pq

    from skycat.plans.queries import processed

    df = processed(spark, "/root/testdata/sf0.001")
    k1, k2 = os.path.join(tmp, "k1"), os.path.join(tmp, "k2")
    cat.write_per_catalog(df, k1)
    cat.write_combined(df, k2)
    assert sorted(d for d in os.listdir(k1) if d.startswith("catalog=")) == sorted(
        f"catalog={m.replace('_clustering.dat.fits', '')}" for m in __import__("skycat.schema", fromlist=["x"]).MANIFEST
    )
    for path in (k1, k2):
        f = sorted(_glob.glob(os.path.join(path, "**", "*.parquet"), recursive=True))[0]
        assert pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD"
    a = cat.read_catalog(spark, k1).select("id", "x").collect()
    b = cat.read_catalog(spark, k2).select("id", "x").collect()
    assert sorted(a) == sorted(b) and len(a) == 5766


def test_packed_append_keeps_all_rows_and_other_jobs_files(spark, tmp):
    from skycat.sources import galbin

    galbin.register(spark)
    path = os.path.join(tmp, "packed")
    rows = lambda a, b: spark.createDataFrame([(float(i), 0.0, 0.0, 1, 2) for i in range(a, b)], galbin.SCHEMA)
    rows(0, 10).repartition(2).write.format("galbin").mode("append").save(path)
    open(os.path.join(path, ".part-otherjob-00000-x.galbin.tmp"), "w").close()
    rows(10, 20).repartition(3).write.format("galbin").mode("append").save(path)
    assert spark.read.format("galbin").load(path).count() == 20
    assert os.path.exists(os.path.join(path, ".part-otherjob-00000-x.galbin.tmp"))
    rows(0, 4).write.format("galbin").mode("overwrite").save(path)
    assert spark.read.format("galbin").load(path).count() == 4


def test_packed_single_file_is_composed_in_parallel(spark, tmp, monkeypatch):
    """The parts of many tasks and the store's one stream give the bytes that one task would write."""
    from skycat.sources import fsio, galbin

    df = _points(spark, 5000).repartitionByRange(7, "x").sortWithinPartitions("x")
    one, many, streamed = (os.path.join(tmp, f"{n}.bin") for n in ("one", "many", "streamed"))
    packed.write_packed(df.coalesce(1), one)
    monkeypatch.setattr(galbin, "FILE_RECORDS", 300)
    packed.write_packed(df, many)
    monkeypatch.setattr(fsio, "local", lambda p: None)
    packed.write_packed(df, streamed)
    want = open(one, "rb").read()
    assert len(want) == 16 + 16 * 5000 and want == open(many, "rb").read() == open(streamed, "rb").read()
    assert sorted(os.listdir(tmp)) == ["many.bin", "one.bin", "streamed.bin"]  # no parts or temporaries stay


def test_packed_folder_keeps_one_whole_version(spark, tmp, monkeypatch):
    """Readers see the old version until the new one's manifest is there, also after a write that died."""
    from skycat.sources import fsio, galbin

    path = os.path.join(tmp, "packed")
    xs = lambda df: sorted(r.x for r in df.collect())
    read = lambda: xs(packed.read_packed(spark, path))
    first, second = _points(spark, 40).repartition(4), _points(spark, 90).repartition(3)
    packed.write_packed(first, path, single_file=False)
    reader = galbin.GalbinReader({"path": path})
    planned, planned_parts = reader.partitions(), galbin.list_files(path)

    class Died(Exception):
        pass

    def dies(src, dst):
        raise Died

    # the new files are there, the manifest is not: as after a crash in commit
    writer = galbin.GalbinWriter({"path": path}, True)
    with monkeypatch.context() as m:
        m.setattr(fsio, "move", dies)
        galbin_rows = galbin.encode_batch(__import__("pyarrow").RecordBatch.from_pydict({"x": [1.0], "y": [1.0], "z_cart": [1.0], "tracer": [1], "z_encoded": [1]}))
        name = f"data-{writer.job}-00000000-a-00000.galbin"
        fsio.write_bytes(fsio.join(path, name), [galbin.header(1), galbin_rows.tobytes()])
        with pytest.raises(Died):
            writer.commit([galbin.FilesWritten(0, [(name, 1)])])
    assert read() == [float(i) for i in range(40)]
    packed.write_packed(second, path, single_file=False)
    assert read() == [float(i) for i in range(90)]
    # a reader that planned before the overwrite still finds its files
    late = sorted(x for p in planned for b in reader.read(p) for x in b.column("x").to_pylist())
    assert late == [float(i) for i in range(40)]
    packed.write_packed(first, path, single_file=False, mode="append")
    assert sorted(read()) == sorted([float(i) for i in range(90)] + [float(i) for i in range(40)])
    assert not any(os.path.exists(p) for p, _ in planned_parts)  # two versions later they are gone
    assert len(galbin.manifests(path)) == 2


def test_packed_folder_of_other_tools(spark, tmp):
    """part-*.galbin files without a manifest are read in name order, and appended to."""
    from skycat.sources import galbin

    for k in range(2):
        packed.write_packed(_points(spark, 5 + k), os.path.join(tmp, f"part-{k}.galbin"))
    assert packed.read_packed(spark, tmp).count() == 11
    packed.write_packed(_points(spark, 3), tmp, single_file=False, mode="append")
    assert [n for _, n in galbin.list_files(tmp)][:2] == [5, 6] and packed.read_packed(spark, tmp).count() == 14
    packed.write_packed(_points(spark, 2), tmp, single_file=False)
    assert packed.read_packed(spark, tmp).count() == 2


def test_uris_keep_their_host():
    from skycat.sources import fsio

    assert fsio._uri(None, "/a/b", "hdfs://nn:8020/a") == "hdfs://nn:8020/a/b"
    assert fsio._uri(None, "bucket/a/b", "s3a://bucket/a") == "s3a://bucket/a/b"
    assert fsio._uri(None, "box/a/b", "abfss://box@account.example/a") == "abfss://box@account.example/a/b"


def test_one_fits_file_by_uri(spark, tmp):
    from skycat.sources import fits

    path = os.path.join(tmp, "LRG_N_clustering.dat.fits")
    fits.write_fits_table(path, {"RA": np.arange(5.0), "DEC": np.arange(5.0), "Z": np.ones(5), "WEIGHT": np.ones(5, np.float32)})
    fits.register(spark)
    assert spark.read.format("fits_table").load(f"file://{path}").count() == 5


def test_fits_byte_ranges_take_each_row_once(spark, tmp, monkeypatch):
    """However the bytes of a file are split, every row is read once, with the tables around it left alone."""
    n = 700
    cols = _fits_cols(n)
    other = fits.bintable_bytes({"A": np.arange(400.0)}, extname="OTHER")
    path = os.path.join(tmp, "ELG_S_clustering.dat.fits")
    fits.write_fits_table(path, cols, before=[other])
    with open(path, "ab") as f:
        f.write(fits.bintable_bytes({"B": np.arange(900.0)}, extname="AFTER"))
    size = os.path.getsize(path)
    columns = [fits.scan_table(path).column(c) for c in ("TARGETID", "Z")]
    for split in (35, 36, 37, 1000, 2880, size, 10 * size):
        monkeypatch.setattr(fits, "TARGET_PARTITION_BYTES", split)
        monkeypatch.setattr(fits, "OPEN_COST_BYTES", 1)
        reader = fits.FitsTableReader({"path": tmp, "minPartitions": "1"}, columns)
        groups = reader.partitions()
        assert split >= size or len(groups) > size // (split + 1) // 2
        rows = [(r, t, z) for g in groups for b in reader.read(g) for t, z, r in zip(*(b.column(c).to_pylist() for c in ("TARGETID", "Z", "row_index")))]
        assert rows == list(zip(range(n), cols["TARGETID"].tolist(), cols["Z"].tolist()))


def test_fits_planning_reads_no_headers(monkeypatch):
    """A hundred thousand files with known lengths are planned without a request, in a few numbers each."""
    import json
    import pickle

    monkeypatch.setattr(fits, "scan_table", None)
    monkeypatch.setattr(fits.fsio, "resolve", None)
    files = [f"/none/{i:06d}.fits" for i in range(100_000)]
    lengths = [(i % 50) << 20 for i in range(100_000)]
    reader = fits.FitsTableReader({"paths": json.dumps(files), "lengths": json.dumps(lengths)}, [])
    groups = reader.partitions()
    assert sum(len(g.ranges) for g in groups) == 100_000  # none is longer than a split; empty ones are read for their header
    assert max(len(pickle.dumps(g)) for g in groups) < 10_000


def test_fits_truncated_file_is_refused(spark, tmp):
    path = os.path.join(tmp, "QSO_N_clustering.dat.fits")
    fits.write_fits_table(path, _fits_cols(500))
    with open(path, "rb+") as f:
        f.truncate(os.path.getsize(path) - 2880 * 3)
    with pytest.raises(Exception, match="truncated table data"):
        cat.read_raw(spark, tmp).collect()
