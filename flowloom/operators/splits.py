"""Train / val / test assignment as a ``split`` column.

Sizes follow ``int(n * ratio)`` in double arithmetic with the remainder going to
test. Random splits are ordered by md5("seed:id"), which is uniform, repeatable
and the same in other engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.stats import percent_of
from flowloom.operators import labels as L
from flowloom.operators.ranking import BUCKET_ROWS, bounded_buckets, hash_key, hex_digits, range_bucketed, ranked
from flowloom.session import staged


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {train + val + test}")


def valid_ratios(train: Column, val: Column, test: Column) -> Column:
    """`check_ratios` for ratios that are columns of a table."""
    return F.abs(train + val + test - 1.0) < 1e-6


def assign(rank: Column, size: Column, train: float, val: float) -> Column:
    n_train = F.floor(size * F.lit(train))
    n_val = F.floor(size * F.lit(val))
    return (
        F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")
    )


def _hash_split(
    samples: DataFrame,
    group: Sequence[str],
    seed: int | Column,
    row_id: str,
    choose: Callable[[Column, Column], Column],
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Split by place in the random order, without sorting the rows.

    ``choose(rank, size)`` must be constant but for a few cuts. Rows are counted per
    slice of the order; a slice whose first and last rows get the same split is decided
    as a whole. The slices in which a cut falls, two per group at most, are counted again
    by further digits of the order while they hold more than ``rows`` rows, and what is
    then left of them is ranked.
    """
    samples = samples.drop("split")
    keyed = samples.withColumn("_key", hash_key(seed, row_id))
    # structs compare null fields as equal, so a null group is one like any other
    keyed = keyed.withColumn("_group", F.struct(*group) if group else F.struct(F.lit(0)))
    digits = hex_digits("_key", 5)
    out = [*samples.columns, "split"]
    prefix, open_rows, result = ["_group"], keyed, None
    while True:
        name = f"_slice{len(prefix)}"
        cut = open_rows.withColumn(name, digits[len(prefix) - 1])
        slices = staged(_slices(cut, prefix, name, choose, len(prefix) == 1), "slices")
        prefix = [*prefix, name]
        placed = cut.drop("_base", "_size").join(slices.drop("_n"), prefix)
        decided = placed.filter(F.col("split").isNotNull()).select(*out)
        result = decided if result is None else result.unionByName(decided)
        open_rows = placed.filter(F.col("split").isNull())
        crowded = slices.where(F.col("split").isNull() & (F.col("_n") > rows))
        if len(prefix) > len(digits) or crowded.isEmpty():
            break
        open_rows = open_rows.drop("split")
    inside = Window.partitionBy(*prefix).orderBy("_key", row_id)
    rank = F.col("_base") + F.row_number().over(inside)
    last = open_rows.withColumn("_rank", rank).withColumn("split", choose(F.col("_rank"), F.col("_size")))
    return result.unionByName(last.select(*out))


def _slices(cut: DataFrame, prefix: list[str], name: str, choose, whole_group: bool) -> DataFrame:
    """Per slice the rows before it, the size of its group, and its split if it has one."""
    parent = Window.partitionBy(*prefix)
    earlier = parent.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    counts = [F.count(F.lit(1)).alias("_n")]
    if not whole_group:
        counts += [F.min("_base").alias("_start"), F.min("_size").alias("_size")]
    sized = cut.groupBy(*prefix, name).agg(*counts)
    if whole_group:
        sized = sized.withColumn("_start", F.lit(0)).withColumn("_size", F.sum("_n").over(parent))
    sized = sized.withColumn("_base", F.col("_start") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    size = F.col("_size")
    first, last = choose(F.col("_base") + 1, size), choose(F.col("_base") + F.col("_n"), size)
    return sized.select(*prefix, name, "_n", "_base", "_size", F.when(first == last, first).alias("split"))


def _three_way(train: float, val: float) -> Callable[[Column, Column], Column]:
    return lambda rank, size: assign(rank, size, train, val)


def split_global(
    samples: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42, row_id: str = "sample_id"
) -> DataFrame:
    """Random split over all rows, without regard to class."""
    check_ratios(train, val, 1 - train - val)
    return _hash_split(samples, [], seed, row_id, _three_way(train, val))


def split_per_class(
    samples: DataFrame,
    train: float = 0.8,
    val: float = 0.1,
    seed: int = 42,
    min_samples: int = 10,
    row_id: str = "sample_id",
) -> DataFrame:
    """Random split inside every class; small classes are dropped and ids closed up."""
    kept = L.drop_small_classes(samples, min_samples)
    return _hash_split(kept, ["label_id"], seed, row_id, _three_way(train, val))


def required_class_size(min_samples: int, train: float, val: float, test: float) -> int:
    return int(min_samples / min(train, val, test))


def split_per_class_seeded(
    samples: DataFrame,
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    min_samples: int = 1,
    row_id: str = "sample_id",
) -> DataFrame:
    """Per-class split with its own seed per class (seed + id); ids are kept.

    A class must be large enough for ``min_samples`` rows in its smallest split.
    """
    check_ratios(train, val, test)
    required = required_class_size(min_samples, train, val, test)
    kept = L.keep_valid(samples, L.class_table(samples), required)
    seeds = F.lit(seed) + F.col("label_id")
    return _hash_split(kept, ["label_id"], seeds, row_id, _three_way(train, val))


def split_sequential(
    samples: DataFrame,
    train: float = 0.8,
    val: float = 0.1,
    row_id: str = "sample_id",
    group: Sequence[str] = ("label_id",),
    order: Sequence[str] = (),
) -> DataFrame:
    """Per-class split in stored order, so later samples never train for earlier ones.

    ``order`` names the columns of the stored order if the id itself does not tell it.
    """
    keys = [*order, row_id]
    numbered = ranked(range_bucketed(samples, keys), group, keys, F.col("_range"), "_rank", "_size")
    return numbered.withColumn(
        "split", assign(F.col("_rank"), F.col("_size"), train, val)
    ).drop("_rank", "_size", "_range")


def _proportional_quota(classes: DataFrame, count: str, draws: Column, out: str) -> DataFrame:
    """Per-class share of ``draws``: floors first, then one more by largest remainder.

    Equal remainders go to the lower class id.
    """
    share = F.col(count) / F.sum(count).over(Window.partitionBy()) * draws
    floored = classes.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    missing = draws - F.sum("_floor").over(Window.partitionBy())
    place = F.row_number().over(
        Window.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), F.asc("label_id"))
    )
    return (
        floored.withColumn("_missing", missing)
        .withColumn("_place", place)
        .withColumn(out, F.col("_floor") + F.when(F.col("_place") <= F.col("_missing"), 1).otherwise(0))
        .drop("_share", "_floor", "_missing", "_place")
    )


def stratified_quotas(classes: DataFrame, val: float, test: float) -> DataFrame:
    """Two-stage stratified sizes per class: train against the rest, then val against test.

    Held-out sizes are rounded up, first for val + test and then for test.
    """
    total = F.sum("n").over(Window.partitionBy())
    held = F.ceil(F.round(total * F.lit(val + test), 9))
    sized = classes.withColumn("_held", held).withColumn("_train_total", total - F.col("_held"))
    sized = _proportional_quota(sized, "n", F.col("_train_total"), "n_train")
    sized = sized.withColumn("_rest", F.col("n") - F.col("n_train"))
    test_total = F.ceil(F.round(F.col("_held") * F.lit(1 - val / (val + test)), 9))
    sized = sized.withColumn("_val_total", F.col("_held") - test_total)
    sized = _proportional_quota(sized, "_rest", F.col("_val_total"), "n_val")
    return sized.select("label_id", "n", "n_train", "n_val")


def _random_ranks(
    samples: DataFrame, group: Sequence[str], seed: int, row_id: str, rows: int = BUCKET_ROWS
) -> DataFrame:
    """``_rank`` of every row in the random order of its group; no task ranks more than ``rows``."""
    keyed = samples.withColumn("_key", hash_key(seed, row_id))
    cut = bounded_buckets(keyed, group, hex_digits("_key"), rows)
    return ranked(cut, group, ["_key", row_id], F.col("_radix"), "_rank").drop("_key", "_radix")


def split_stratified(
    samples: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42, row_id: str = "sample_id"
) -> DataFrame:
    quotas = staged(stratified_quotas(L.class_table(samples), val, test), "quotas")
    numbered = _random_ranks(samples, ["label_id"], seed, row_id)
    split = (
        F.when(F.col("_rank") <= F.col("n_train"), "train")
        .when(F.col("_rank") <= F.col("n_train") + F.col("n_val"), "val")
        .otherwise("test")
    )
    return (
        numbered.join(quotas.select("label_id", "n_train", "n_val"), "label_id")
        .withColumn("split", split)
        .drop("_rank", "n_train", "n_val")
    )


def split_test_first(
    samples: DataFrame, test: float = 0.1, seed: int = 42, row_id: str = "sample_id"
) -> DataFrame:
    """Two-way split: the first ``int(n * test)`` rows of the random order are test."""

    def choose(rank: Column, size: Column) -> Column:
        return F.when(rank <= F.floor(size * F.lit(test)), "test").otherwise("train")

    return _hash_split(samples, [], seed, row_id, choose)


def batch_ids(
    samples: DataFrame, batch_size: int, seed: int = 42, row_id: str = "sample_id", rows: int = BUCKET_ROWS
) -> DataFrame:
    """Batch number of every row in the global random order."""
    numbered = _random_ranks(samples, [], seed, row_id, rows)
    return numbered.withColumn("batch_id", F.floor((F.col("_rank") - 1) / batch_size)).drop("_rank")


def split_statistics(split: DataFrame) -> DataFrame:
    counts = split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", percent_of(F.col("n"), F.sum("n").over(Window.partitionBy())))
