"""Spark session helpers.

Cluster settings (shuffle partitions, checkpoint dir, AQE) normally come from the
submitting environment; ``get_spark`` only fills in what is unset so the same code
runs in tests on ``local[*]`` and on a cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "twinstage", **conf: str) -> SparkSession:
    """Return the active session, or build one. Submitted settings win: defaults fill only keys that
    nobody set, and the master is touched only if it is asked for or none was submitted."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    start = SparkConf(loadDefaults=False).set("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():  # what is asked for here has to be there when the JVM starts (memory)
        start.set(k, v)
    SparkContext._ensure_initialized(conf=start)
    submitted = SparkConf()  # now holds what was submitted
    builder = SparkSession.builder
    if not submitted.contains("spark.app.name"):
        builder = builder.appName(app)
    wanted = master or os.environ.get("TWINSTAGE_MASTER") or (None if submitted.contains("spark.master") else "local[*]")
    if wanted:
        builder = builder.master(wanted)
    for k, v in {**{k: v for k, v in _LOCAL_DEFAULTS.items() if not submitted.contains(k)}, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder for checkpoints, stream state and written tables."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    current = spark.sparkContext.getCheckpointDir()
    return current.rsplit("/", 1)[0] if current else None  # Spark adds a per-app subfolder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only local runs get a scratch one."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = checkpoint_root(spark)
    if existing:
        return existing
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="twinstage-ckpt-", dir="/tmp")
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # noqa: BLE001 — some deployments reject core confs at run time
        pass
    spark.sparkContext.setCheckpointDir(path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one driver table; column pruning / pushdown happen at the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
