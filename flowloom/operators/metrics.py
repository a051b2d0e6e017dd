"""Scores of class predictions.

Everything is derived from the confusion counts, which take one map-side combined
pass over the predictions and have at most one row per (label, prediction) pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.stats import ratio_or_zero
from flowloom.functions.text import label_or_default
from flowloom.operators.labels import class_skeleton


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Observed (label, pred) pairs with their counts."""
    return predictions.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def _known_classes(counts: DataFrame, num_classes: int) -> DataFrame:
    """``counts``; a class id that is null or not below ``num_classes`` is an error."""
    both = F.col("label").between(0, num_classes - 1) & F.col("pred").between(0, num_classes - 1)
    said = F.format_string("class ids (%s, %s) are not below %s", F.col("label").cast("string"), F.col("pred").cast("string"), F.lit(str(num_classes)))
    kind = counts.schema["label"].dataType
    checked = F.when(F.coalesce(both, F.lit(False)), F.col("label")).otherwise(F.raise_error(said).cast(kind))
    return counts.withColumn("label", checked)


def confusion_dense(counts: DataFrame, num_classes: int) -> DataFrame:
    """Every pair of class ids, 0 where it was not observed."""
    ids = F.sequence(F.lit(0), F.lit(num_classes - 1))
    grid = class_skeleton(counts.sparkSession, num_classes, "label").withColumn("pred", F.explode(ids))
    return grid.join(_known_classes(counts, num_classes), ["label", "pred"], "left").fillna({"n": 0})


def confusion_rows(counts: DataFrame, num_classes: int) -> DataFrame:
    """One row per true class with the counts of all predicted classes as an array."""
    row = F.sort_array(F.collect_list(F.struct("pred", "n")))
    rows = confusion_dense(counts, num_classes).groupBy("label").agg(row.alias("_row"))
    return rows.select("label", F.transform("_row", lambda cell: cell["n"]).alias("counts"))


def confusion_wide(counts: DataFrame, num_classes: int) -> DataFrame:
    """One row per true class, one column per predicted class.

    The columns are entries of one array, so their number does not grow the aggregate.
    """
    columns = [F.get("counts", F.lit(c)).alias(f"pred_{c}") for c in range(num_classes)]
    return confusion_rows(counts, num_classes).select("label", *columns)


def outcome_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn per class that occurs as label or prediction."""
    hit = F.col("label") == F.col("pred")
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    as_label = F.struct(
        F.col("label").cast("bigint").alias("class_id"),
        F.when(hit, n).otherwise(zero).alias("tp"),
        zero.alias("fp"),
        F.when(hit, zero).otherwise(n).alias("fn"),
    )
    as_pred = F.struct(
        F.col("pred").cast("bigint").alias("class_id"),
        zero.alias("tp"),
        F.when(hit, zero).otherwise(n).alias("fp"),
        zero.alias("fn"),
    )
    sides = counts.select(*by, F.inline(F.array(as_label, as_pred)))
    return sides.groupBy(*by, "class_id").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )


def class_scores(counts: DataFrame, num_classes: int | None = None) -> DataFrame:
    """Precision, recall, F1, TPR, FPR, support and accuracy per class.

    With ``num_classes`` every id below it gets a row; without, only the classes
    that occur as label or prediction.
    """
    outcomes = outcome_counts(counts if num_classes is None else _known_classes(counts, num_classes))
    if num_classes is not None:
        skeleton = class_skeleton(counts.sparkSession, num_classes, "class_id")
        outcomes = skeleton.join(outcomes, "class_id", "left").fillna({"tp": 0, "fp": 0, "fn": 0})
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    # every sample is counted once as label: as a hit or as a miss of its class
    total = F.sum(tp + fn).over(Window.partitionBy())
    scored = outcomes.withColumn("tn", total - tp - fp - fn).withColumn("support", tp + fn)
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    scored = scored.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    return (
        scored.withColumn("f1", ratio_or_zero(2 * p * r, p + r))
        .withColumn("tpr", r)
        .withColumn("fpr", ratio_or_zero(fp, fp + F.col("tn")))
        .withColumn("class_accuracy", tp / (F.col("support") + F.lit(1e-10)))
    )


def accuracy(counts: DataFrame) -> DataFrame:
    hits = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    return counts.agg((hits / F.sum("n")).alias("accuracy"))


def _weighted(score: str | Column) -> Column:
    value = F.col(score) if isinstance(score, str) else score
    return F.sum(value * F.col("support")) / F.sum("support")


def weighted_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(*[_weighted(s).alias(f"weighted_{s}") for s in ("precision", "recall", "f1")])


def macro_scores(scores: DataFrame) -> DataFrame:
    """Plain mean over the rows of ``scores``.

    Over a skeleton this divides by the number of classes; over occurring classes
    it divides by how many of those there are.
    """
    return scores.agg(*[F.avg(s).alias(f"macro_{s}") for s in ("precision", "recall", "f1")])


def weighted_rates(scores: DataFrame) -> DataFrame:
    return scores.agg(_weighted("tpr").alias("tpr_avg"), _weighted("fpr").alias("fpr_avg"))


def plain_rates(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("tpr").alias("tpr_avg"), F.avg("fpr").alias("fpr_avg"))


def ftf(scores: DataFrame) -> DataFrame:
    """Support-weighted sum of TPR / (1 + FPR)."""
    return scores.agg(_weighted(F.col("tpr") / (1 + F.col("fpr"))).alias("ftf"))


def summary(counts: DataFrame, num_classes: int) -> DataFrame:
    """All single-number scores in one row."""
    scores = class_scores(counts, num_classes)
    return scores.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[_weighted(s).alias(f"weighted_{s}") for s in ("precision", "recall", "f1")],
        *[F.avg(s).alias(f"macro_{s}") for s in ("precision", "recall", "f1")],
        _weighted("tpr").alias("tpr_avg"),
        _weighted("fpr").alias("fpr_avg"),
        _weighted(F.col("tpr") / (1 + F.col("fpr"))).alias("ftf"),
    )


def is_confident(threshold: float = 0.9) -> Column:
    return F.col("confidence") >= threshold


def confident_scores(predictions: DataFrame, threshold: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """Share of confident predictions and the accuracy among them (0 if there are none)."""
    sure = is_confident(threshold)
    hit = F.col("label") == F.col("pred")
    n = F.count_if(sure)
    return predictions.groupBy(*by).agg(
        ratio_or_zero(F.count_if(sure & hit), n).alias("confidence_accuracy"),
        ratio_or_zero(n, F.count(F.lit(1))).alias("confidence_ratio"),
    )


def named_scores(scores: DataFrame, label_map: DataFrame, style: str = "Class_{}") -> DataFrame:
    """Class scores with names; classes that were never seen keep their zero rows."""
    names = label_map.select(
        F.col("label_id").cast("bigint").alias("class_id"), F.col("label").alias("_name")
    )
    return scores.join(names, "class_id", "left").withColumn(
        "class_name", label_or_default(F.col("_name"), F.col("class_id"), style)
    ).drop("_name")


def report(counts: DataFrame, num_classes: int, label_map: DataFrame | None = None) -> DataFrame:
    """Class rows followed by accuracy, macro and weighted rows."""
    scores = class_scores(counts, num_classes)
    if label_map is not None:
        scores = named_scores(scores, label_map)
    else:
        scores = scores.withColumn("class_name", F.concat(F.lit("Class_"), F.col("class_id")))
    value = ("precision", "recall", "f1")
    rows = scores.select(F.col("class_name").alias("row_name"), *value, "support")
    total = F.sum("support").alias("support")
    hit_rate = F.sum("tp") / F.sum("support")
    overall = scores.agg(
        hit_rate.alias("a"),
        total,
        *[F.avg(v).alias(f"m_{v}") for v in value],
        *[_weighted(v).alias(f"w_{v}") for v in value],
    )
    line = lambda name, columns: F.struct(
        F.lit(name).alias("row_name"), *[F.col(c).alias(v) for c, v in zip(columns, value)], "support"
    )
    summary_rows = overall.select(
        F.inline(
            F.array(
                line("accuracy", ["a", "a", "a"]),
                line("macro avg", [f"m_{v}" for v in value]),
                line("weighted avg", [f"w_{v}" for v in value]),
            )
        )
    )
    return rows.unionByName(summary_rows)


def split_scores(predictions: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Accuracy, confident accuracy and ratio per split from one scoring pass."""
    hit = F.col("label") == F.col("pred")
    sure = is_confident(threshold)
    return predictions.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit.cast("double")).alias("accuracy"),
        ratio_or_zero(F.count_if(sure & hit), F.count_if(sure)).alias("confidence_accuracy"),
        ratio_or_zero(F.count_if(sure), F.count(F.lit(1))).alias("confidence_ratio"),
    )


def _is_number(metric: str) -> Column:
    value = F.col(metric).cast("double")
    return value.isNotNull() & ~F.isnan(value)


def best_epochs(history: DataFrame, metric: str = "metric") -> DataFrame:
    """Epoch with the highest metric per run; the earliest one wins a tie.

    Epochs without a number (null or NaN, a diverged run) are never the best.
    """
    history = history.filter(_is_number(metric))
    best = F.max(F.struct(F.col(metric), (-F.col("epoch")).alias("_e")))
    return (
        history.groupBy("run")
        .agg(best.alias("_best"))
        .select("run", (-F.col("_best._e")).alias("best_epoch"), F.col(f"_best.{metric}").alias("best"))
    )


def running_best(history: DataFrame, metric: str = "metric", start: float = 0.0) -> DataFrame:
    """Mark epochs that beat every number before them, starting from ``start``."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    number = F.when(_is_number(metric), F.col(metric))
    best = F.greatest(F.coalesce(F.max(number).over(before), F.lit(start)), F.lit(start))
    return history.withColumn("is_best", F.coalesce(number > best, F.lit(False)))
