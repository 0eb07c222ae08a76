"""Session helpers: defaults that matter for correctness and scale."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

# Settings every sifter job relies on.  UTC keeps timestamp rendering stable;
# AQE re-plans joins and coalesces partitions from runtime statistics.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "sifter",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with sifter's defaults.

    On a cluster, leave ``master`` unset so spark-submit decides.  The UI is
    kept off: sifter jobs are batch jobs and need no server.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the checkpoint folder the session uses.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; nothing machine-local is ever set there.  Only a local-mode
    session without one (tests, a laptop) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            return None  # leave it to the cluster configuration
        configured = tempfile.mkdtemp(prefix="sifter-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``sifter`` importable in the Python workers (``addPyFile``, the
    programmatic ``--py-files``), once per application.

    Arrow-batched steps (``mapInPandas``, ``applyInPandas``) run sifter code
    in the executors' Python workers, which do not share the driver's
    ``sys.path``.  The zip is built on the driver and served to executors by
    Spark itself.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    with _SHIP_LOCK:
        if key in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg)
        zpath = os.path.join(tempfile.mkdtemp(prefix="sifter-pkg-"), "sifter.zip")
        with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
            for dirpath, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(zpath)
        _SHIPPED.add(key)
