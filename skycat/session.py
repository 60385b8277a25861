"""Session helpers: local sessions for tests/bench, checkpoint directory policy."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(
    cpus: int | str = "*", shuffle_partitions: int | None = None, app: str = "skycat", conf: dict | None = None
) -> SparkSession:
    """A local session for tests and the bench.  On a cluster use the cluster's own."""
    n = str(cpus)
    parts = shuffle_partitions or (8 if n == "*" else max(1, int(n)))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SKYCAT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "1000000000")
    )
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory (``spark.checkpoint.dir``).

    On a cluster this names a shared, reliable folder and is used as is; a
    cluster session without one is refused.  Only a local session (tests)
    without one gets a folder of our own.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a shared, reliable folder: checkpoints and "
                "derived tables must survive the loss of any one machine"
            )
        d = tempfile.mkdtemp(prefix="skycat-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``skycat`` importable in Python workers (once per application).

    Python-side operators (data sources, ``mapInArrow``) run code from this
    package on the executors.  The package is zipped on the driver and added
    with ``addPyFile``, which Spark distributes to every executor, as
    ``--py-files`` would.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="skycat-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
