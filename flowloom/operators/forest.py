"""Random forest training with MLlib and probability voting on tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import metrics
from flowloom.operators.corpus import union_all
from flowloom.operators.scaling import clean


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clean the feature columns and add the ``features`` vector."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    return assembler.transform(clean(df, columns))


def fit_forest(
    train: DataFrame,
    columns: Sequence[str],
    label: str = "label_id",
    trees: int = 100,
    depth: int = 20,
    seed: int = 42,
) -> RandomForestClassificationModel:
    """Bootstrapped forest with sqrt(features) candidates per split.

    The input is not cached here: MLlib keeps its own binned copy.
    """
    forest = RandomForestClassifier(
        labelCol=label,
        featuresCol="features",
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )
    return forest.fit(assemble(train, columns))


def predict(
    model: RandomForestClassificationModel,
    df: DataFrame,
    columns: Sequence[str],
    label: str = "label_id",
    threshold: float = 0.9,
) -> DataFrame:
    """Class, confidence and confident flag per row; equal probabilities give the lower id."""
    scored = model.transform(assemble(df, columns))
    probabilities = vector_to_array("probability")
    kept = [c for c in ("sample_id", "split") if c in df.columns]
    return scored.select(
        *kept,
        F.col(label).cast("bigint").alias("label"),
        (F.array_position(probabilities, F.array_max(probabilities)) - 1).alias("pred"),
        F.array_max(probabilities).alias("confidence"),
    ).withColumn("is_confident", metrics.is_confident(threshold))


def evaluate_saved(
    path: str, df: DataFrame, columns: Sequence[str], label: str = "label_id", threshold: float = 0.9
) -> DataFrame:
    """Score val and test with a stored model in one pass, one result row per split."""
    model = RandomForestClassificationModel.load(path)
    held_out = df.filter(F.col("split").isin("val", "test"))
    return metrics.split_scores(predict(model, held_out, columns, label, threshold), threshold)


def train_and_score(
    datasets: Mapping[str, DataFrame],
    columns: Sequence[str],
    label: str = "label_id",
    threshold: float = 0.9,
    **forest,
) -> DataFrame:
    """Fit one forest per dataset and tabulate its val and test scores."""
    results = []
    for name, df in datasets.items():
        model = fit_forest(df.filter(F.col("split") == "train"), columns, label, **forest)
        held_out = df.filter(F.col("split").isin("val", "test"))
        scores = metrics.split_scores(predict(model, held_out, columns, label, threshold), threshold)
        results.append(scores.withColumn("dataset", F.lit(name)))
    return union_all(results)


def feature_importance(
    spark: SparkSession, model: RandomForestClassificationModel, columns: Sequence[str]
) -> DataFrame:
    """Normalised mean importance per feature (one row per column)."""
    values = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return spark.createDataFrame(values, "feature string, importance double")


def tree_importance(
    spark: SparkSession, model: RandomForestClassificationModel, columns: Sequence[str]
) -> DataFrame:
    """Normalised importance per tree and feature."""
    values = [
        (i, c, float(v))
        for i, tree in enumerate(model.trees)
        for c, v in zip(columns, tree.featureImportances.toArray())
    ]
    return spark.createDataFrame(values, "tree int, feature string, importance double")


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), F.asc("feature")).limit(n)


def mean_importance(per_tree: DataFrame) -> DataFrame:
    """Mean over trees of (tree, feature, importance) rows."""
    return per_tree.groupBy("feature").agg(F.avg("importance").alias("importance"))


def _argmax(probabilities: DataFrame, digits: int) -> DataFrame:
    # rounding makes equal sums tie whatever order they were added in; the confidence
    # that is returned is not rounded
    rounded = F.round("prob", digits)
    best = F.max(F.struct(rounded.alias("p"), (-F.col("class_id")).alias("c"), "prob"))
    return (
        probabilities.groupBy("sample_id")
        .agg(best.alias("_best"))
        .select(
            "sample_id", (-F.col("_best.c")).alias("pred"), F.col("_best.prob").alias("confidence")
        )
    )


def soft_vote(votes: DataFrame, n_trees: int, digits: int = 9) -> DataFrame:
    """Mean class probability over trees, best class per sample, ties to the lower id."""
    mean = votes.groupBy("sample_id", "class_id").agg((F.sum("prob") / n_trees).alias("prob"))
    return _argmax(mean, digits)


def weighted_vote(first: DataFrame, second: DataFrame, weight: float, digits: int = 9) -> DataFrame:
    """Best class of ``weight * p1 + (1 - weight) * p2`` over two probability tables.

    A class missing from one table counts as probability 0 there.
    """
    scaled = [
        df.select("sample_id", "class_id", (F.col("prob") * w).alias("prob"))
        for df, w in ((first, weight), (second, 1 - weight))
    ]
    total = union_all(scaled).groupBy("sample_id", "class_id").agg(F.sum("prob").alias("prob"))
    return _argmax(total, digits)


# --- votes as one probability vector per row, for many classes ---


def _vector(df: DataFrame, name: str) -> Column:
    """The column as a vector; arrays of numbers are taken as one value per class."""
    return F.col(name) if df.schema[name].dataType.typeName() == "vectorudt" else array_to_vector(name)


def _best_class(total: Column, digits: int) -> tuple[Column, Column]:
    """Position and value of the largest entry; equal entries, once rounded, go to the lower id."""
    rounded = F.transform(total, lambda p: F.round(p, digits))
    place = F.array_position(rounded, F.array_max(rounded))
    return place - 1, F.get(total, (place - 1).cast("int"))


def _vector_argmax(totals: DataFrame, digits: int) -> DataFrame:
    pred, confidence = _best_class(F.col("_total"), digits)
    return totals.select("sample_id", pred.alias("pred"), confidence.alias("confidence"))


def soft_vote_vectors(
    votes: DataFrame, n_trees: int, digits: int = 9, probabilities: str = "probabilities"
) -> DataFrame:
    """`soft_vote` of (sample, tree) rows that hold one probability per class.

    Vectors are added up inside each task before they are shuffled, so a sample costs one
    row per task however many trees and classes there are. All rows have as many classes.
    """
    slim = votes.select("sample_id", _vector(votes, probabilities).alias("_v"))
    sums = slim.groupBy("sample_id").agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("_sum"))
    mean = F.transform("_sum", lambda p: p / n_trees)
    return _vector_argmax(sums.select("sample_id", mean.alias("_total")), digits)


def weighted_vote_vectors(
    first: DataFrame, second: DataFrame, weight: float, digits: int = 9, probabilities: str = "probabilities"
) -> DataFrame:
    """`weighted_vote` of two tables with one row and one probability vector per sample.

    A sample missing from one table counts as probability 0 there.
    """
    sides = [
        df.select("sample_id", _vector(df, probabilities).alias("_v"), F.lit(w).alias("_w"))
        for df, w in ((first, weight), (second, 1 - weight))
    ]
    total = vector_to_array(Summarizer.sum(F.col("_v"), F.col("_w")))
    return _vector_argmax(union_all(sides).groupBy("sample_id").agg(total.alias("_total")), digits)
