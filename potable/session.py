"""Spark session helpers.

Cluster jobs get their settings from the deployment; ``local_session`` is for
tests and the bench only. ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from
the running session and only falls back to a fresh scratch folder when the
setting is absent (local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "potable") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and durable run tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (read from the
    session; it is a core setting and cannot be changed at run time). Only when
    it is absent the SparkContext's checkpoint folder is used, or, with a local
    master (tests), a new scratch folder is made and registered with
    ``setCheckpointDir``. Any other master without a shared folder is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    app = sc.applicationId
    if app not in _LOCAL_DIRS:
        current = sc.getCheckpointDir()
        if not current and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not current:
            current = tempfile.mkdtemp(prefix="potable-ckpt-")
            sc.setCheckpointDir(current)
        _LOCAL_DIRS[app] = current
    return _LOCAL_DIRS[app]


def run_folder(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for a named run table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name
