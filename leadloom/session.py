"""Session settings for the jobs of this package."""
from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the operators rely on. Partition counts are left to the cluster: adaptive execution
# coalesces small shuffle partitions and splits skewed join partitions.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # aggregates with small object buffers keep hashing instead of sorting from the 129th key on
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
    # the call site of every column is not recorded: plans of thousands of expressions build faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "leadloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared checkpoint folder of the cluster; `fallback` only where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if fallback:
        spark.sparkContext.setCheckpointDir(fallback)
    return fallback
