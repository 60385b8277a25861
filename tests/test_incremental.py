"""Incremental ingest: what is there is skipped, and the catalogue is always that of a full run."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycat.plans import ingest as I
from skycat.sources import fits


def table(n, seed, z=None):
    rng = np.random.default_rng(seed)
    z = rng.uniform(0.1, 1.0, n) if z is None else np.full(n, z)
    return {"RA": rng.uniform(0, 360, n), "DEC": rng.uniform(-90, 90, n), "Z": z, "WEIGHT": np.ones(n, np.float32)}


def rows(spark, out):
    df = spark.read.parquet(out)
    return sorted(map(tuple, df.select("catalog", "source", "row_index", "ra", "x", "z").collect()))


def full(spark, raw, tmp, name):
    out = os.path.join(tmp, name)
    return I.ingest(spark, raw, out, incremental=False), rows(spark, out)


def names(paths):
    return sorted("/".join(p.split("/")[-2:]) for p in paths)


def test_runs_over_a_changing_folder(spark, tmp, monkeypatch):
    raw, out = os.path.join(tmp, "raw"), os.path.join(tmp, "out")
    at = lambda part, name: os.path.join(raw, part, f"{name}_clustering.dat.fits")
    fits.write_fits_table(at("a", "LRG_N"), table(50, 1))
    fits.write_fits_table(at("b", "LRG_N"), table(30, 2))
    fits.write_fits_table(at("a", "QSO_S"), table(20, 3))
    first = I.ingest(spark, raw, out)
    assert first.total == 100 and len(first.read) == 3

    # nothing new: nothing is read
    again = I.ingest(spark, raw, out)
    assert again.read == [] and again.total == 100 and rows(spark, out) == full(spark, raw, tmp, "f0")[1]

    # one more file of a catalogue that is there, and one that is cut whole
    fits.write_fits_table(at("c", "LRG_N"), table(40, 4))
    fits.write_fits_table(at("c", "ELG_LOPnotqso_N"), table(10, 5, z=6.0))
    more = I.ingest(spark, raw, out)
    assert names(more.read) == ["c/ELG_LOPnotqso_N_clustering.dat.fits", "c/LRG_N_clustering.dat.fits"]
    whole, want = full(spark, raw, tmp, "f1")
    assert rows(spark, out) == want and more.total == whole.total == 140

    # a file changes, another goes
    fits.write_fits_table(at("a", "LRG_N"), table(70, 6))
    os.utime(at("a", "LRG_N"), (2e9, 2e9))
    os.remove(at("a", "QSO_S"))
    changed = I.ingest(spark, raw, out)
    assert names(changed.read) == ["a/LRG_N_clustering.dat.fits"] and changed.total == 140
    assert rows(spark, out) == full(spark, raw, tmp, "f2")[1]

    # a file that was there has no rows left
    fits.write_fits_table(at("b", "LRG_N"), table(30, 2, z=6.0))
    os.utime(at("b", "LRG_N"), (2.1e9, 2.1e9))
    assert I.ingest(spark, raw, out).total == 110 and rows(spark, out) == full(spark, raw, tmp, "f3")[1]

    # a run that dies after its rows are written is repeated by the next
    fits.write_fits_table(at("d", "BGS_BRIGHT_N"), table(15, 7))
    with monkeypatch.context() as m:
        m.setattr(I, "file_metrics", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            I.ingest(spark, raw, out)
    last = I.ingest(spark, raw, out)
    assert names(last.read) == ["d/BGS_BRIGHT_N_clustering.dat.fits"] and rows(spark, out) == full(spark, raw, tmp, "f4")[1]


def test_metrics_of_each_input_file(spark, tmp):
    """One row per input file where names repeat, with output paths that exist."""
    raw, out = os.path.join(tmp, "raw"), os.path.join(tmp, "out")
    for part, n in (("a", 50), ("b", 30)):
        fits.write_fits_table(os.path.join(raw, part, "LRG_N_clustering.dat.fits"), table(n, n))
    fits.write_fits_table(os.path.join(raw, "a", "QSO_S_clustering.dat.fits"), table(5, 1, z=6.0))
    res = I.ingest(spark, raw, out, id_from_path=True)
    got = {tuple(r.path.split("/")[-2:]): r for r in res.summary.collect()}
    assert {k: r.n_galaxies for k, r in got.items()} == {("a", "LRG_N_clustering.dat.fits"): 50, ("b", "LRG_N_clustering.dat.fits"): 30, ("a", "QSO_S_clustering.dat.fits"): 0}
    for (part, name), r in got.items():
        if not r.n_galaxies:
            assert r.output is None and r.z_min is None and r.n_files == 0 and r.tracer == "QSO"
            continue
        mine = spark.read.parquet(r.output)
        assert mine.count() == r.n_galaxies and len([f for f in os.listdir(r.output) if f.endswith(".parquet")]) == r.n_files
        assert mine.agg(F.min("z"), F.max("z")).first() == (r.z_min, r.z_max)
        assert {p.path.split("/")[-2] for p in mine.select("path").distinct().collect()} == {part}
    (lrg,) = [r for r in I.by_catalog(res.summary).collect() if r.catalog == "LRG_N"]
    assert lrg.n_galaxies == 80 and lrg.output == "LRG_N_clustering.dat.parquet"


def test_only_cut_files(spark, tmp):
    raw, out = os.path.join(tmp, "raw"), os.path.join(tmp, "out")
    fits.write_fits_table(os.path.join(raw, "QSO_S_clustering.dat.fits"), table(5, 1, z=6.0))
    res = I.ingest(spark, raw, out)
    assert res.total == 0 and [r.n_galaxies for r in res.summary.collect()] == [0]
    assert I.ingest(spark, raw, out).read == []
