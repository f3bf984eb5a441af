"""Spark session helpers.

The library never builds its own cluster configuration for production: on a
cluster the session comes from the platform and every setting below that is
already present is left alone.  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every query of the library relies on.  Timestamps in the inputs are
# TIMESTAMP_NTZ; the few casts to TIMESTAMP are only correct in UTC.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "trialframe") -> SparkSession:
    """Session for tests and the bench: local mode, UI off, AQE on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TRIALFRAME_DRIVER_MEMORY", "4g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the settings the library needs where the session has none of its own."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    The context's checkpoint directory is registered from that setting once.
    Only in local mode, where one machine runs all, a fresh scratch folder is
    created when the session has none; a cluster must name a shared folder.  (With Spark Connect
    there is no context; the server's setting is used as is.)
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:          # Spark Connect: the server owns the checkpoint folder
        return d or ""
    current = sc.getCheckpointDir()
    d = d or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not current and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not d:
        d = current or tempfile.mkdtemp(prefix="trialframe-ckpt-", dir="/tmp")
    if not current:
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
