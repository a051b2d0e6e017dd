"""Reading and writing sample tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.stats import finite_or_zero
from flowloom.operators import labels as L
from flowloom.session import staged

# Payload columns by priority.
PAYLOAD_COLUMNS = ("images", "features", "flows", "sequences", "data", "X")
SPLITS = ("train", "val", "test")


def payload_column(df: DataFrame) -> str:
    for name in PAYLOAD_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"no payload column among {df.columns}")


def select_payload(df: DataFrame, others: Sequence[str] = ("label",)) -> DataFrame:
    """Payload under the common name ``payload`` next to ``others``."""
    return df.select(*others, F.col(payload_column(df)).alias("payload"))


def features_from_csv(
    spark: SparkSession, path: str, feature_columns: Sequence[str] | None = None, label: str = "label"
) -> DataFrame:
    """Feature columns as doubles and the label encoded by sorted distinct value."""
    rows = spark.read.option("header", "true").csv(path)
    names = list(feature_columns) if feature_columns else [c for c in rows.columns if c != label]
    typed = rows.select(label, *[F.col(c).cast("double").alias(c) for c in names])
    return L.encode_labels(typed, label)


def read_sequences(spark: SparkSession, path: str, min_packets: int = 0) -> DataFrame:
    """`{"lengths": [...]}` documents with at least ``min_packets`` values."""
    rows = spark.read.schema("lengths ARRAY<INT>").option("recursiveFileLookup", "true").json(path)
    return rows.filter(F.size("lengths") >= min_packets)


def write_sequences(seqs: DataFrame, path: str, min_packets: int = 0) -> None:
    seqs.filter(F.size("lengths") >= min_packets).select("lengths").write.json(path)


def write_by_class(samples: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per split and class.

    Rows are rebalanced by folder first: small classes share a task and give one
    file each, a class that is too large for one task is spread over several.
    """
    keys = [c for c in ("split", "label") if c in samples.columns]
    clustered = samples.hint("rebalance", *keys)
    writer = clustered.write.option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy(*keys).parquet(path)


def write_dataset(samples: DataFrame, path: str) -> None:
    samples.write.parquet(path)


def write_label_map(label_map: DataFrame, path: str, **extra: str) -> None:
    """label_id / label rows, with any extra metadata as constant columns."""
    with_extra = label_map.select("label_id", "label", *[F.lit(v).alias(k) for k, v in extra.items()])
    with_extra.write.json(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label_id BIGINT, label STRING").json(path)


def write_class_counts(samples: DataFrame, path: str) -> None:
    counts = L.class_counts(samples, ["label", "label_id"])
    counts.select(F.col("label").alias("class"), F.col("label_id").alias("class_id"), F.col("n").alias("count")).write.option(
        "header", "true"
    ).csv(path)


def dataset_meta(samples: DataFrame, **extra: str) -> DataFrame:
    """One row: class and sample totals with constant metadata.

    Samples are counted per class first, so no distinct runs over the rows.
    """
    per_class = L.class_counts(samples, ["label"])
    totals = per_class.agg(
        F.count(F.lit(1)).alias("num_classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples")
    )
    return totals.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])


def read_classes(
    spark: SparkSession, path: str, label_map: DataFrame, payload: str, min_samples: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Samples of the usable classes with dense ids, and a table of the skipped ones.

    A class of ``label_map`` is skipped when its folder is missing, when all its
    rows lack ``payload``, or when it is smaller than ``min_samples``.
    """
    return usable_classes(spark.read.parquet(path), label_map, payload, min_samples)


def usable_classes(
    rows: DataFrame, label_map: DataFrame, payload: str, min_samples: int
) -> tuple[DataFrame, DataFrame]:
    present = F.col(payload).isNotNull() if payload in rows.columns else F.lit(False)
    seen = staged(
        rows.groupBy("label").agg(F.count(F.lit(1)).alias("_rows"), F.count_if(present).alias("n")),
        "class-sizes",
    )
    known = label_map.select("label_id", "label").join(seen, "label", "left")
    reason = (
        F.when(F.col("_rows").isNull(), "missing")
        .when(F.col("n") == 0, "no payload")
        .when(F.col("n") < min_samples, "too few samples")
    )
    judged = known.withColumn("reason", reason)
    skipped = judged.filter(F.col("reason").isNotNull()).select(
        "label", F.coalesce("n", F.lit(0)).alias("n"), "reason"
    )
    kept = L.dense_ids(judged.filter(F.col("reason").isNull()), ["label_id"])
    if payload not in rows.columns:
        rows = rows.withColumn(payload, F.lit(None).cast("string"))
    samples = rows.filter(F.col(payload).isNotNull())
    samples = samples.drop("label_id") if "label_id" in samples.columns else samples
    return samples.join(kept.select("label", F.col("new_id").alias("label_id")), "label"), skipped


def combine_splits(parts: dict[str, DataFrame | None]) -> DataFrame:
    """One table from a single, train/test or train/val/test layout; a missing part is empty.

    A part named "all" keeps its own split column, or has none.
    """
    tables = []
    for name, df in parts.items():
        if df is None:
            continue
        tables.append(df if name == "all" else df.withColumn("split", F.lit(name)))
    if not tables:
        raise ValueError("every part is missing")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_dataset(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """A combined dataset with NaN and infinities in ``columns`` replaced by 0."""
    rows = spark.read.parquet(path)
    return rows.withColumns({c: finite_or_zero(F.col(c)) for c in columns}) if columns else rows


def read_split(spark: SparkSession, path: str, split: str, label_map: DataFrame | None = None) -> DataFrame:
    """One split of a partitioned dataset; other split folders are not listed or read."""
    rows = spark.read.parquet(path).filter(F.col("split") == split)
    return rows.join(label_map, "label") if label_map is not None else rows


def read_unlabelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Payloads of all classes without labels, and the number of samples per file."""
    rows = spark.read.parquet(path)
    payload = rows.select(F.col(payload_column(rows)).alias("payload"))
    per_file = rows.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return payload, per_file


def inventory(samples: DataFrame) -> DataFrame:
    """Samples per split and class."""
    return samples.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def inventory_totals(samples: DataFrame) -> DataFrame:
    """One row: total samples and number of classes over all splits."""
    per_class = inventory(samples).groupBy("label").agg(F.sum("n").alias("n"))
    return per_class.agg(F.sum("n").alias("total_samples"), F.count(F.lit(1)).alias("num_classes"))
