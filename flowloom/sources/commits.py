"""Datasets written class by class, so that an interrupted build goes on where it stopped.

A commit covers some classes: their rows replace whatever the class folders hold
(dynamic partition overwrite), and then a manifest that names the classes is renamed into
place. Only classes of a manifest are taken as done or read. A build that stops
between the two steps leaves rows without a manifest; they are not read, and the next
build writes the same classes over them. So no class is lost or there twice, wherever a
build stops.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators import labels as L
from flowloom.session import staged

# Spark's readers pass over names that begin with an underscore
MANIFESTS = "_commits"
_MANIFEST = "label STRING, n BIGINT"


def _file_system(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def completed_classes(spark: SparkSession, path: str) -> DataFrame:
    """``label, n`` of the classes a commit covers; a class without rows has ``n`` 0."""
    system, folder = _file_system(spark, f"{path}/{MANIFESTS}")
    if not system.exists(folder):
        return spark.createDataFrame([], _MANIFEST)
    # manifests that were not renamed into place begin with an underscore too
    return spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(str(folder)).dropDuplicates(["label"])


def write_classes(rows: DataFrame, path: str) -> None:
    """Replace the class folders of the classes in ``rows``; others stay as they are."""
    writer = rows.hint("rebalance", "label").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("label").parquet(path)


def record_commit(classes: DataFrame, path: str) -> None:
    """Make ``classes`` (label, n) part of the dataset: the manifest appears under its name at once."""
    spark = classes.sparkSession
    name = uuid.uuid4().hex
    classes.select("label", "n").coalesce(1).write.parquet(f"{path}/{MANIFESTS}/_{name}")
    system, source = _file_system(spark, f"{path}/{MANIFESTS}/_{name}")
    _, target = _file_system(spark, f"{path}/{MANIFESTS}/{name}")
    if not system.rename(source, target):
        raise OSError(f"manifest {target} could not be put in place")


def build_pending(
    sources: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    path: str,
    classes_per_commit: int = 100,
    max_commits: int | None = None,
) -> int:
    """Build the classes of ``sources`` that no commit covers, and return the number of commits made.

    ``build`` turns source rows of some classes into sample rows with the same ``label``.
    Classes are dealt to commits by rank of their name. ``max_commits`` ends the call
    early; another call goes on with what is left.
    """
    spark = sources.sparkSession
    labels = sources.where("label is not null").select("label").distinct()
    pending = staged(L.dense_ids(L.not_completed(labels, completed_classes(spark, path)), ["label"], "_no"), "pending")
    last = pending.agg(F.max("_no")).first()[0]
    wanted = 0 if last is None else last // classes_per_commit + 1
    commits = wanted if max_commits is None else min(wanted, max_commits)
    for commit in range(commits):
        chosen = pending.where(F.floor(F.col("_no") / classes_per_commit) == commit).select("label")
        rows = build(sources.join(chosen, "label", "left_semi"))
        write_classes(rows, path)
        counts = _folders(spark, path, rows.schema).join(chosen, "label", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        # counted in the folders, as they stand
        record_commit(chosen.join(counts, "label", "left").fillna({"n": 0}), path)
    return commits


def _folders(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """Rows of all class folders; a class name such as 007 stays text."""
    found = schema or spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name == "label" else f.dataType) for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_committed(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of the classes that a commit covers; ``schema`` where no class may have rows."""
    return _folders(spark, path, schema).join(completed_classes(spark, path).where("n > 0"), "label", "left_semi")
