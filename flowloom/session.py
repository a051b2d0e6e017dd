"""Session settings and shared-storage staging."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. All are session-level and can be
# overridden by the caller after `configure`.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # first-N truncation goes up to 5000 packets per flow; the optimizer only
    # prunes before the shuffle when N is within this threshold
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # per-flow arrays are bounded by the truncation, so more groups may stay in
    # the hash map before the aggregate falls back to sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # a streamed batch of files is looked up path by path; the default makes a task of
    # every path up to 10,000
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
}

_local_staging: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster without
    the setting is an error, because executors would not see the same files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_staging:
        _local_staging[app] = tempfile.mkdtemp(prefix="flowloom-")
    return _local_staging[app]


def staging_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/flowloom/{app}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to shared storage once and read it back.

    Used for class tables and other aggregates that several later steps need. A
    reader of the written table knows its size, so a following join is broadcast
    only when it is below ``spark.sql.autoBroadcastJoinThreshold`` and is a
    shuffled join (with adaptive skew splitting) when it is not. The files also
    survive the loss of executors.
    """
    spark = df.sparkSession
    path = staging_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
