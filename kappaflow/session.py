"""Spark session and cluster-shared folders.

Tests and the bench build a local session here; on a cluster the caller
hands in its own session and nothing below overrides cluster settings.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings that only make sense for a local test session.  On a cluster the
# operator's spark-defaults win: we never touch a session we did not build.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # In one process every shuffle block is local: reading by mapper saves nothing and leaves a
    # file of one row group, which one task reads, to one task of the next stage too.
    "spark.sql.adaptive.localShuffleReader.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    # A few MB of texts are work for all cores, not for the one or two tasks that 1 MB each would give.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Keeps nondeterministic-free plans; parquet pushdown is the default.
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: str | int = "*", app: str = "kappaflow", **extra) -> SparkSession:
    conf = dict(LOCAL_CONF)
    conf.update({k.replace("__", "."): str(v) for k, v in extra.items()})
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there (HDFS / object store).  Only a local
    session without the setting, as in tests, gets a temporary one; elsewhere
    each executor would write to its own disk, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder; the master is {master}")
        d = tempfile.mkdtemp(prefix="kappaflow-ckpt-", dir=os.environ.get("KAPPAFLOW_LOCAL_DIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: a sub-folder of the shared checkpoint dir."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/stages"
