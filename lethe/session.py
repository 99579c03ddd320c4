"""Session helpers: local sessions for tests/bench, and the shared checkpoint folder.

On a cluster the session is created by the platform; we only read its settings.
``checkpoint_dir`` honours ``spark.checkpoint.dir``.  A session without one gets a folder
of its own only where everything runs in one process (``local[*]``: tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"

# Readers deal a table's rows over this many partitions; 0 (the default) leaves the scan as
# it is.  Local sessions set it because the test files are single row groups.
SPREAD = "spark.lethe.spread"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lethe") -> SparkSession:
    """A local session configured like the cluster profile (AQE on, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config(SPREAD, str(cpus) if str(cpus).isdigit() else str(os.cpu_count()))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster, or a fresh one in a local session."""
    current = spark.conf.get(_CKPT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {_CKPT_KEY} to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="lethe-ckpt-")
        spark.conf.set(_CKPT_KEY, current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

