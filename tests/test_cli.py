"""The command line runs the two original steps end to end (process, export)."""

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF_SMALL


def _run(*args, tmp):
    env = dict(os.environ, PYTHONPATH=ROOT, SPARK_LOCAL_DIRS=tmp)
    return subprocess.run([sys.executable, "-m", "skycat", *args], cwd=tmp, env=env, capture_output=True, text=True, timeout=600)


def test_process_then_export(spark, tmp):
    from skycat.plans.derived import raw_catalog
    from skycat.plans.fixtures import write_fits_catalogs

    raw = os.path.join(tmp, "raw")
    write_fits_catalogs(raw_catalog(spark, SF_SMALL).repartition(4), raw).collect()
    out = _run("process", raw, os.path.join(tmp, "processed"), tmp=tmp)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "5,766 galaxies" in out.stdout and "LRG_N" in out.stdout
    # the targets exceed this small catalogue: every tracer is taken whole
    out = _run("export", os.path.join(tmp, "processed"), os.path.join(tmp, "web"), tmp=tmp)
    assert out.returncode == 0 and json.load(open(os.path.join(tmp, "web", "metadata.json")))["n_points"] == 5766
    assert os.path.getsize(os.path.join(tmp, "web", "galaxies.bin")) == 16 + 16 * 5766
    # nothing is read twice; the combined table holds all rows
    out = _run("process", raw, os.path.join(tmp, "processed"), "--combined", os.path.join(tmp, "combined"), tmp=tmp)
    assert out.returncode == 0 and "files read: 0" in out.stdout and "5,766 galaxies" in out.stdout
    assert spark.read.parquet(os.path.join(tmp, "combined")).count() == 5766
    out = _run("validate", os.path.join(tmp, "processed"), tmp=tmp)
    assert out.returncode == 0 and "n_outside_range" in out.stdout
    # the fixture holds each catalogue in several files: the key of the file is part of the identity
    assert "source" in spark.read.parquet(os.path.join(tmp, "processed")).columns
    out = _run("scene", os.path.join(tmp, "processed"), os.path.join(tmp, "scene"), "--max-points", "1000", tmp=tmp)
    assert out.returncode == 0, out.stderr[-2000:]
    assert spark.read.parquet(os.path.join(tmp, "scene")).count() == 1000
