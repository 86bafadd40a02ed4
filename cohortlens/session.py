"""Spark session helpers.

Library code never creates its own session: every function takes DataFrames
(or a session passed in). These helpers are for scripts, tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours should carry. AQE re-plans joins from runtime
# sizes (a runtime size check before any broadcast) and splits skewed join
# partitions; timestamps are compared in UTC against the DuckDB oracle.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8,
              driver_memory: str = "16g", app: str = "cohortlens",
              extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.driver.memory", driver_memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this names a shared folder and is read as is; it must be set
    there. Only a local session without it (tests) gets a fresh scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir() if hasattr(
            spark.sparkContext, "getCheckpointDir") else None
    if current:
        return current
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="cohortlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df, eager: bool = True):
    """Cut the lineage of a stage output that later stages read more than
    once: a reliable checkpoint into ``spark.checkpoint.dir`` (a shared
    folder on a cluster), so a lost executor does not replay the whole
    upstream plan and the optimizer sees a plain scan instead of the same
    subtree many times over."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def fan_out_partitions(spark: SparkSession, factor: int = 4) -> int:
    """Partitions for the input of a fan-out (explode into many variants), so
    that the multiplied work is spread over all cores: adaptive execution
    sizes partitions by their input bytes and would put a small input, and
    with it all of its variants, into one task. An explicit count is kept
    by adaptive execution."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * factor)
