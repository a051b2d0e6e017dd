"""Labelled samples to scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import forest, metrics, splits
from flowloom.operators import labels as L
from flowloom.session import staged


def split_and_score(
    samples: DataFrame,
    columns: Sequence[str],
    row_id: str = "sample_id",
    threshold: float = 0.9,
    **forest_options,
) -> DataFrame:
    """Random 8:1:1 split, one forest on train, scores of val and test."""
    split = staged(splits.split_global(samples, row_id=row_id), "split")
    model = forest.fit_forest(split.filter(F.col("split") == "train"), columns, **forest_options)
    held_out = split.filter(F.col("split").isin("val", "test"))
    return metrics.split_scores(forest.predict(model, held_out, columns, threshold=threshold), threshold)


def curated_top_k(samples: DataFrame, k: int, min_samples: int = 1) -> DataFrame:
    """Per-class seeded split followed by the ``k`` classes largest in val."""
    split = staged(splits.split_per_class_seeded(samples, min_samples=min_samples), "split")
    return L.top_k_by_split(split, k)
