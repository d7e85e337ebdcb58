"""Session helpers.

The library never reconfigures a session it is handed, with one exception:
a checkpoint directory is set only when the cluster has not named one
(``spark.checkpoint.dir``), which happens in tests and local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tradelens") -> SparkSession:
    """A local session for tests, benchmarks and notebooks.

    AQE stays on so that small lookup sides become broadcasts at run time,
    partitions are coalesced and skewed join partitions are split.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRADELENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # catalog tables of local runs (e.g. the bucketed layout) go to a temp folder
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tradelens-warehouse-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder
    and is used as is; a machine-local folder is only ever chosen when the
    setting is absent (tests, local runs).
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or \
        spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder on the shared file system "
            "(a machine-local folder is not visible to other executors)")
    path = tempfile.mkdtemp(prefix="tradelens-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tradelens/{name}-{uuid.uuid4().hex}"
