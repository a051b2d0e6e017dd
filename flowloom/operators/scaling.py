"""Cleaning and normalising numeric feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.stats import finite_or_zero, percent_of
from flowloom.session import staged


def clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite_or_zero(F.col(c)) for c in columns})


def bad_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinite values over all columns, one pass."""
    nan = sum((F.count_if(F.isnan(c)) for c in columns[1:]), F.count_if(F.isnan(columns[0])))
    inf_of = lambda c: F.count_if(F.abs(F.col(c)) == float("inf"))
    inf = sum((inf_of(c) for c in columns[1:]), inf_of(columns[0]))
    return df.agg(nan.alias("nan_count"), inf.alias("inf_count"))


def matrix_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, mean and population std over every cell of the (cleaned) matrix.

    Columns are aggregated side by side and pooled on the one result row, so the
    matrix is never unpivoted.
    """
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts += [
            F.min(x).alias(f"_{c}_min"),
            F.max(x).alias(f"_{c}_max"),
            F.avg(x).alias(f"_{c}_mean"),
            F.var_pop(x).alias(f"_{c}_var"),
        ]
    pick = lambda s: [F.col(f"_{c}_{s}") for c in columns]
    mean_of = lambda values: sum(values[1:], values[0]) / F.lit(float(len(values)))
    one = df.agg(*parts).withColumn("mean", mean_of(pick("mean")))
    spread = [v + F.pow(m - F.col("mean"), F.lit(2)) for v, m in zip(pick("var"), pick("mean"))]
    return one.select(
        F.least(*pick("min")).alias("min") if len(columns) > 1 else pick("min")[0].alias("min"),
        F.greatest(*pick("max")).alias("max") if len(columns) > 1 else pick("max")[0].alias("max"),
        "mean",
        F.sqrt(mean_of(spread)).alias("std"),
    )


def fit_scaler(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), epsilon: float | None = None
) -> DataFrame:
    """``<c>_mean`` and ``<c>_std`` per column; one row, or one per ``by`` value.

    A zero deviation becomes 1, or with ``epsilon`` that is added to every deviation.
    """
    parts = []
    for c in columns:
        std = F.stddev_pop(c)
        scale = F.when(std == 0, F.lit(1.0)).otherwise(std) if epsilon is None else std + F.lit(epsilon)
        parts += [F.avg(c).alias(f"{c}_mean"), scale.alias(f"{c}_std")]
    return df.groupBy(*by).agg(*parts) if by else df.agg(*parts)


def apply_scaler(
    df: DataFrame, params: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """z-scores. Parameters are one row (an aggregate without keys) unless ``by`` is given.

    Keyed parameters are staged, so that the rows are not shuffled on a handful of
    keys when the parameter table is small.
    """
    if by:
        joined = df.join(staged(params, "scaler"), list(by))
    else:
        # one row, whatever was given: more than one is an error
        only = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(*params.columns))).otherwise(
            F.raise_error(F.lit("scaler parameters must be one row"))
        )
        joined = df.crossJoin(F.broadcast(params.agg(only.alias("_p")).select("_p.*")))
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def scale_splits(df: DataFrame, columns: Sequence[str], own_test: bool = False) -> DataFrame:
    """Scale all splits by train parameters, or test by its own for cross-domain sets.

    Parameters and rows meet on a two-valued domain, computed once per domain.
    """
    domain = F.when(F.col("split") == "test", "test").otherwise("train")
    rows = df.withColumn("_domain", domain if own_test else F.lit("train"))
    fitted_on = rows if own_test else rows.filter(F.col("split") == "train")
    fitted_on = fitted_on.filter(F.col("split") != "val")
    params = fit_scaler(fitted_on, columns, ["_domain"])
    wide = params.groupBy().pivot("_domain", ["train", "test"]).agg(
        *[F.first(f"{c}_{s}").alias(f"{c}_{s}") for c in columns for s in ("mean", "std")]
    )
    joined = rows.crossJoin(F.broadcast(wide))
    pick = lambda c, s: F.when(
        F.col("_domain") == "test", F.col(f"test_{c}_{s}")
    ).otherwise(F.col(f"train_{c}_{s}"))
    return joined.withColumns(
        {c: (F.col(c) - pick(c, "mean")) / pick(c, "std") for c in columns}
    ).select(*df.columns)


def sequence_length_statistics(seqs: DataFrame, value: str) -> DataFrame:
    size = F.size(value)
    return seqs.agg(
        F.min(size).alias("min"),
        F.max(size).alias("max"),
        F.avg(size).alias("mean"),
        F.stddev_pop(size).alias("std"),
    )


def absolute_length_statistics(seqs: DataFrame, value: str) -> DataFrame:
    values = seqs.select(F.explode(value).alias("x")).select(F.abs("x").alias("x"))
    return values.agg(
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
    )


def direction_statistics(seqs: DataFrame, value: str) -> DataFrame:
    """+1 and -1 counts with their percent."""
    values = seqs.select(F.explode(value).alias("x"))
    counts = values.agg(
        F.count_if(F.col("x") == 1).alias("outgoing"),
        F.count_if(F.col("x") == -1).alias("incoming"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.withColumn("outgoing_pct", percent_of(F.col("outgoing"), F.col("total"))).withColumn(
        "incoming_pct", percent_of(F.col("incoming"), F.col("total"))
    )
