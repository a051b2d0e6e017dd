"""Result tables from training log text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.text import base_name

# The line formats the logs are written in.
ACCURACY_LINE = r"^\s*Accuracy:\s*([0-9.]+)\s*$"
F1_LINE = r"^\s*F1(?: Score)?:\s*([0-9.]+)\s*$"
EPOCH_LINE = (
    r"Epoch\s+(\d+) \| Train Loss: ([0-9.]+) \| Train Acc: ([0-9.]+) \| "
    r"Val Acc: ([0-9.]+) \| Val F1: ([0-9.]+)( \*)?"
)
EPOCH_FIELDS = ("train_loss", "train_acc", "val_acc", "val_f1")


def read_log_lines(spark: SparkSession, path: str, run_folder: bool = False) -> DataFrame:
    """Text lines of every log with its run and a sort key of the line's place in the file.

    The run is the file name without suffix, or with ``run_folder`` the folder the
    file is in (a leading ``key=`` is dropped). Logs are read line by line and large
    ones in blocks; the key is the block's start and then the row's number in it.
    """
    read = spark.read.option("recursiveFileLookup", "true").text(path)
    file = F.url_decode(F.input_file_name())
    if run_folder:
        run = F.regexp_replace(F.element_at(F.split(file, "/"), -2), "^[^=]*=", "")
    else:
        run = F.regexp_replace(base_name(file), r"\.[^.]*$", "")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = read.select(run.alias("run"), place.alias("line_no"), F.col("value").alias("line"))
    return lines.filter(F.col("line") != "")


def run_results(lines: DataFrame) -> DataFrame:
    """Last accuracy and F1 stated by each run; a run without any has nulls."""
    found = lines.select(
        "run",
        "line_no",
        F.regexp_extract("line", ACCURACY_LINE, 1).alias("_acc"),
        F.regexp_extract("line", F1_LINE, 1).alias("_f1"),
    )
    last = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("line_no")))
    return found.groupBy("run").agg(
        last("_acc").cast("double").alias("accuracy"), last("_f1").cast("double").alias("f1")
    )


def epoch_history(lines: DataFrame) -> DataFrame:
    """One row per epoch line: losses, scores and the best-so-far mark."""
    part = lambda i: F.regexp_extract("line", EPOCH_LINE, i)
    rows = lines.filter(F.col("line").rlike(EPOCH_LINE))
    return rows.select(
        "run",
        part(1).cast("bigint").alias("epoch"),
        *[part(i + 2).cast("double").alias(name) for i, name in enumerate(EPOCH_FIELDS)],
        (part(6) != "").alias("is_best"),
    )


def experiment_summary(results: DataFrame) -> DataFrame:
    """Number of runs, how many gave a result, and the mean of their scores."""
    ok = F.col("accuracy").isNotNull() | F.col("f1").isNotNull()
    return results.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(ok).alias("n_success"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.avg("f1").alias("mean_f1"),
    )


def experiment_table(results: DataFrame) -> DataFrame:
    """One row per run with its status."""
    ok = F.col("accuracy").isNotNull() | F.col("f1").isNotNull()
    return results.withColumn("status", F.when(ok, "success").otherwise("no metrics"))
