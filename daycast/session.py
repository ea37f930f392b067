"""Session construction and lineage checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Defaults tuned for the daily-bar workloads: AQE re-plans joins and
# coalesces the many small post-aggregation partitions; the session zone
# is pinned to UTC so dates never shift between driver and executors.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    # Fits of several folds run at once, each in a pool of its own.
    "spark.scheduler.mode": "FAIR",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Bar-level stages are tiny in bytes but CPU-heavy (60+ window frames
    # per row): let AQE keep one partition per ~64 KB instead of merging a
    # whole bar table into a single task. Tick-level stages are far above
    # this floor, so it changes nothing there.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(master: str | None = None, app_name: str = "daycast",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults.

    ``master`` is only set when given, so on a cluster the launcher's
    master wins. ``shuffle_partitions`` should be sized so one shuffle
    partition stays around 128-256 MB at the target scale.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be on shared storage and is read from the
    session. Only a local-mode session without the setting (tests, the
    bench) gets a fresh private folder, because a machine-local folder is
    useless to executors on other hosts.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) so lineage can be cut on a cluster")
        configured = tempfile.mkdtemp(prefix="daycast-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new folder of the shared checkpoint folder, and read back.

    Cuts the lineage like ``checkpoint()``; as Parquet, so that each later use reads only
    the columns it needs."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``daycast`` importable in executor Python workers.

    Grouped-map functions reference this package's helpers by module name,
    so workers must be able to import it. The package is zipped once per
    application and distributed with ``SparkContext.addPyFile`` (the driver
    serves the file to every executor; nothing needs shared storage).
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    # A worker's matrix routines get the cores of its task, not all of the machine's.
    sc.environment.setdefault("OMP_NUM_THREADS", sc.getConf().get("spark.task.cpus", "1"))
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="daycast-pyfiles-"), "daycast.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("daycast", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
