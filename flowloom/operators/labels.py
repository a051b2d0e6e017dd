"""Class tables, label ids and class selection.

Class tables hold one row per class. They are aggregated once, staged to shared
storage and joined back; whether that join is broadcast is left to Spark, which
knows the size of the staged files. Windows without a partition run on class
tables only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.stats import percent_of
from flowloom.functions.text import label_or_default
from flowloom.session import staged


def class_counts(samples: DataFrame, keys: Sequence[str] = ("label_id",)) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def class_table(samples: DataFrame, keys: Sequence[str] = ("label_id",)) -> DataFrame:
    """`class_counts`, materialised for reuse."""
    return staged(class_counts(samples, keys), "classes")


def dense_ids(classes: DataFrame, order: Sequence, out: str = "new_id") -> DataFrame:
    """Ids 0..k-1 in the given order, over a class table."""
    return classes.withColumn(out, F.row_number().over(Window.orderBy(*order)) - 1)


def encode_labels(samples: DataFrame, label: str = "label", out: str = "label_id") -> DataFrame:
    """Id of each label by sorted distinct value; ids the rows had are replaced."""
    samples = samples.drop(out)
    distinct = staged(samples.select(label).distinct(), "labels")
    return samples.join(dense_ids(distinct, [label], out), label)


def with_names(rows: DataFrame, label_map: DataFrame, style: str = "Unknown({})") -> DataFrame:
    """Attach the class name to each id; ids the map lacks get a default name."""
    joined = rows.join(label_map.select("label_id", F.col("label").alias("_name")), "label_id", "left")
    return joined.withColumn("label", label_or_default(F.col("_name"), F.col("label_id"), style)).drop(
        "_name"
    )


def distribution(samples: DataFrame, keys: Sequence[str] = ("label_id",)) -> DataFrame:
    """Samples and percent of the total per class."""
    counts = class_counts(samples, keys)
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", percent_of(F.col("n"), total))


def valid_classes(classes: DataFrame, min_samples: int) -> DataFrame:
    """Surviving classes with dense ids in ascending old-id order."""
    return dense_ids(classes.filter(F.col("n") >= min_samples), ["label_id"])


def keep_valid(samples: DataFrame, classes: DataFrame, min_samples: int) -> DataFrame:
    kept = classes.filter(F.col("n") >= min_samples).select("label_id")
    return samples.join(kept, "label_id", "left_semi")


def removed_classes(vocabulary: DataFrame, classes: DataFrame, min_samples: int) -> DataFrame:
    """Classes of the vocabulary with too few samples, including those with none."""
    kept = classes.filter(F.col("n") >= min_samples).select("label_id")
    return vocabulary.join(kept, "label_id", "left_anti")


def relabel(samples: DataFrame, id_map: DataFrame) -> DataFrame:
    """Replace ``label_id`` by ``new_id``; rows whose class is not in the map are dropped."""
    return (
        samples.join(id_map.select("label_id", "new_id"), "label_id")
        .withColumn("label_id", F.col("new_id"))
        .drop("new_id")
    )


def drop_small_classes(samples: DataFrame, min_samples: int) -> DataFrame:
    """Remove classes below ``min_samples`` and close the gaps in the ids."""
    return relabel(samples, valid_classes(class_table(samples), min_samples))


def by_size(classes: DataFrame, min_samples: int = 0, out: str = "size_rank") -> DataFrame:
    """1-based rank by descending size; equal sizes by ascending id."""
    kept = classes.filter(F.col("n") >= min_samples)
    return kept.withColumn(
        out, F.row_number().over(Window.orderBy(F.desc("n"), F.asc("label_id")))
    )


def top_classes(classes: DataFrame, k: int, min_samples: int = 0) -> DataFrame:
    """The ``k`` largest classes with new ids in descending size."""
    ranked = by_size(classes, min_samples).filter(F.col("size_rank") <= k)
    return ranked.withColumn("new_id", F.col("size_rank") - 1)


def top_k(samples: DataFrame, k: int, min_samples: int = 0) -> DataFrame:
    return relabel(samples, top_classes(class_table(samples), k, min_samples))


def top_k_many(samples: DataFrame, ks: Sequence[int], min_samples: int = 0) -> DataFrame:
    """Several top-k selections from one ranking; each sample carries the k it belongs to."""
    ranked = by_size(class_table(samples), min_samples)
    per_k = (
        ranked.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks])))
        .filter(F.col("size_rank") <= F.col("top_k"))
        .withColumn("new_id", F.col("size_rank") - 1)
        .select("label_id", "top_k", "new_id")
    )
    return (
        samples.join(per_k, "label_id").withColumn("label_id", F.col("new_id")).drop("new_id")
    )


def top_k_by_split(
    samples: DataFrame, k: int, min_samples: int = 0, chosen_on: str = "val"
) -> DataFrame:
    """Classes chosen by size in one split, applied to all; new ids by sorted name."""
    sizes = class_table(samples.filter(F.col("split") == chosen_on), ["label_id", "label"])
    chosen = by_size(sizes, min_samples).filter(F.col("size_rank") <= k)
    return relabel(samples, dense_ids(chosen, ["label"]))


def first_labels(samples: DataFrame, n: int, label: str = "label") -> DataFrame:
    """Samples of the first ``n`` labels in sorted order."""
    chosen = samples.select(label).distinct().orderBy(label).limit(n)
    return samples.join(chosen, label, "left_semi")


def not_completed(captures: DataFrame, completed: DataFrame, label: str = "label") -> DataFrame:
    return captures.join(completed.select(label).distinct(), label, "left_anti")


def class_skeleton(spark, num_classes: int, name: str = "label_id") -> DataFrame:
    return spark.range(num_classes).withColumnRenamed("id", name)


def zero_filled_counts(samples: DataFrame, num_classes: int) -> DataFrame:
    """A count for every class id below ``num_classes``, 0 where nothing was seen."""
    skeleton = class_skeleton(samples.sparkSession, num_classes)
    return skeleton.join(class_counts(samples), "label_id", "left").fillna({"n": 0})


def class_weights(samples: DataFrame, num_classes: int) -> DataFrame:
    """total / (num_classes * count); 1.0 for an empty class."""
    counts = zero_filled_counts(samples, num_classes)
    total = F.sum("n").over(Window.partitionBy())
    weight = F.when(F.col("n") > 0, total / (F.lit(num_classes) * F.col("n"))).otherwise(1.0)
    return counts.withColumn("weight", weight)


def num_classes(samples: DataFrame, label_map: DataFrame | None = None) -> DataFrame:
    """One row: highest id + 1, from the label map when there is one."""
    source = label_map if label_map is not None else samples
    return source.agg((F.max("label_id") + 1).alias("num_classes"))
