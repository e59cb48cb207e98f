"""Spark session settings shared by the library, the tests and the bench.

Everything that affects results (time zone, ANSI mode) is pinned here so a
model gives the same rows on a laptop and on a cluster.  Everything that
affects only speed (shuffle partitions, AQE knobs) has a cluster-friendly
default that callers may override.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the models rely on for correct results.
RESULT_CONF = {
    # Epoch conversions and date truncation must not depend on the host zone.
    "spark.sql.session.timeZone": "UTC",
    # Text timestamps without a zone are read as TIMESTAMP_NTZ (wall clock),
    # which is what the staging models cast to.
    "spark.sql.ansi.enabled": "true",
}

# A task sorts the rows of its part of a table, which staging makes about 25 times as large as
# in Parquet: 16 MiB of it keep that sort in memory, at Spark's 128 MiB it is spilled.
SCAN_CONF = {"spark.sql.files.maxPartitionBytes": "16m"}

# Settings that only change the physical plan.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Dimension joins: let AQE turn a sort-merge join into a broadcast join
    # once the real (runtime) size of the small side is known.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # No broadcast on a guess from file sizes: only measured stages (AQE) and
    # hinted sides of a proven bound are broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # PySpark otherwise makes ~5 extra JVM round trips per API call to record
    # the Python call site for error messages; plans are built from many
    # small calls, so this is most of the driver-side planning time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "tidewater",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Create (or fetch) a session with the library's settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {**RESULT_CONF, **SCAN_CONF, **PLAN_CONF}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_result_conf(spark)
    return spark


def apply_result_conf(spark: SparkSession) -> None:
    """Pin the result-affecting settings, and the size of a scan's tasks, on an existing session."""
    for k, v in {**RESULT_CONF, **SCAN_CONF}.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.
    Only in a local session (tests, bench) a scratch folder is created when it
    is unset; on a cluster that is an error, for no local folder is shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="tidewater-ckpt-")
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def warehouse_dir(spark: SparkSession) -> str:
    """Folder for materialised layer tables (SNK-4).

    ``tidewater.warehouse.dir`` wins; otherwise a ``warehouse`` folder under
    the shared checkpoint directory.
    """
    path = spark.conf.get("tidewater.warehouse.dir", None)
    if not path:
        path = os.path.join(checkpoint_dir(spark).rstrip("/"), "warehouse")
        spark.conf.set("tidewater.warehouse.dir", path)
    return path
