"""Combining corpora and assembling cross-domain experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.stats import percent_of
from flowloom.operators import labels as L
from flowloom.operators.splits import split_sequential
from flowloom.session import staged


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def all_pages(corpus_b: DataFrame) -> DataFrame:
    """Homepage and subpage samples together."""
    return corpus_b.filter(F.col("page_type").isin("homepage", "subpage"))


def label_union(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    return a.select(label).union(b.select(label)).distinct()


def unified_label_map(map_a: DataFrame, map_b: DataFrame) -> DataFrame:
    """New ids over the sorted union of both maps' names."""
    return L.dense_ids(label_union(map_a, map_b), ["label"], "unified_id")


def align_labels(map_b: DataFrame, map_a: DataFrame) -> DataFrame:
    """Unified map with the id each corpus used for the name (null where absent)."""
    return (
        unified_label_map(map_a, map_b)
        .join(map_b.select("label", F.col("label_id").alias("b_id")), "label", "left")
        .join(map_a.select("label", F.col("label_id").alias("a_id")), "label", "left")
    )


def merge_datasets(datasets: Mapping[str, DataFrame], full: bool = False) -> DataFrame:
    """Union of datasets with labels prefixed by their source, ids assigned in order.

    Only train rows are taken unless ``full``. New ids run over the sources in
    the given order and the sorted labels within each. A class is its source and
    its label there: two classes whose merged names read the same keep two ids.
    """
    parts = []
    for position, (name, df) in enumerate(datasets.items()):
        part = df if full or "split" not in df.columns else df.filter(F.col("split") == "train")
        parts.append(
            part.withColumn("source_dataset", F.lit(name))
            .withColumn("source_label", F.col("label"))
            .withColumn("label", F.concat_ws("_", F.lit(name), F.col("label")))
            .withColumn("_position", F.lit(position))
        )
    merged = union_all(parts)
    merged = merged.drop("label_id").withColumn("_class", F.struct("_position", "source_label"))
    names = staged(merged.select("_class").distinct(), "merged-labels")
    ids = L.dense_ids(names, ["_class"], "label_id").select("_class", "label_id")
    return merged.join(ids, "_class").drop("_class", "_position")


def merge_statistics(merged: DataFrame) -> DataFrame:
    """Classes, samples and percent per source.

    Counted per (source, label there) first, so the distinct count runs on class rows.
    """
    per_class = merged.groupBy("source_dataset", "source_label").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_class.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum("_n").alias("n_samples")
    )
    total = F.sum("n_samples").over(Window.partitionBy())
    return counts.withColumn("pct", percent_of(F.col("n_samples"), total))


def page_type_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("page_type").agg(F.count(F.lit(1)).alias("n"))


def _aligned(corpus: DataFrame, unified: DataFrame) -> DataFrame:
    rows = corpus.drop("label_id") if "label_id" in corpus.columns else corpus
    return rows.join(unified.select("label", F.col("unified_id").alias("label_id")), "label")


def _unified(corpus_b: DataFrame, corpus_a: DataFrame) -> DataFrame:
    return staged(unified_label_map(corpus_a, corpus_b), "unified-labels")


def homepage_experiment(
    corpus_b: DataFrame, corpus_a: DataFrame, row_id: str = "sample_id", order: Sequence[str] = ()
) -> DataFrame:
    """Train and val on homepages; test on all subpages and all aggregate sessions.

    The last tenth of every homepage class belongs to no split and is left out.
    """
    unified = _unified(corpus_b, corpus_a)
    pages = _aligned(corpus_b, unified)
    home = split_sequential(pages.filter(F.col("page_type") == "homepage"), row_id=row_id, order=order)
    test = union_all(
        [pages.filter(F.col("page_type") == "subpage"), _aligned(corpus_a, unified)]
    ).withColumn("split", F.lit("test"))
    return union_all([home.filter(F.col("split") != "test"), test])


def all_pages_experiment(
    corpus_b: DataFrame, corpus_a: DataFrame, row_id: str = "sample_id", order: Sequence[str] = ()
) -> DataFrame:
    """Train and val on all single pages; test on aggregate sessions only.

    Homepages come before subpages in the stored order of a class. As above, the
    last tenth of every class is left out.
    """
    unified = _unified(corpus_b, corpus_a)
    pages = all_pages(_aligned(corpus_b, unified))
    homepages_first = F.when(F.col("page_type") == "homepage", 0).otherwise(1)
    train = split_sequential(
        pages.withColumn("_domain", homepages_first), row_id=row_id, order=["_domain", *order]
    ).drop("_domain")
    test = _aligned(corpus_a, unified).withColumn("split", F.lit("test"))
    return union_all([train.filter(F.col("split") != "test"), test])


def aggregate_experiment(
    corpus_a: DataFrame, row_id: str = "sample_id", order: Sequence[str] = ()
) -> DataFrame:
    """Aggregate sessions only, 80/10/10 in stored order."""
    return split_sequential(L.encode_labels(corpus_a), row_id=row_id, order=order)
