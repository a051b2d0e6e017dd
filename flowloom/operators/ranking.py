"""Row numbers and per-group limits that stay parallel when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from flowloom.session import staged

Window = w.Window

# rows of a group that are sorted in one task
BUCKET_ROWS = 1_000_000


def hash_key(seed: int | Column, row_id: str | Column) -> Column:
    """Reproducible pseudo-random order key: md5 of "seed:id"."""
    seed_text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    row = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat_ws(":", seed_text, row.cast("string")))


def hash_bucket(key: str | Column) -> Column:
    """First three hex digits: 4096 equal slices in key order."""
    return hex_digits(key, 1)[0]


def block_bucket(position: str | Column, rows: int = 65536) -> Column:
    """Consecutive blocks of a unique integer; no block holds more than ``rows`` rows."""
    column = F.col(position) if isinstance(position, str) else position
    return F.floor(column / F.lit(rows))


def range_bucketed(df: DataFrame, order: Sequence[str], bucket: str = "_range") -> DataFrame:
    """``df`` with a bucket that does not decrease along ``order``, whatever its type.

    Rows are range-partitioned, so a bucket holds about as many rows as any other
    partition, for text and hashed ids as well as for dense numbers. The result is
    staged: the bucket is the number of the partition a row was written from.
    """
    ranged = df.repartitionByRange(*order).withColumn(bucket, F.spark_partition_id())
    return staged(ranged, "ranges")


def long_digits(value: Column) -> list[Column]:
    """A 64-bit integer as four digits, coarse to fine: the top 28 bits, then 12 each.

    Of a time in microseconds the first digit is 19 hours, the second 17 seconds,
    the third 4 milliseconds.
    """
    parts = [F.shiftright(value, 12 * k) for k in (3, 2, 1, 0)]
    return [parts[0], *[p.bitwiseAND(F.lit(4095)) for p in parts[1:]]]


def hex_digits(key: str | Column, digits: int = 4) -> list[Column]:
    """A hexadecimal key as digits of three characters, 4096 values each."""
    column = F.col(key) if isinstance(key, str) else key
    return [F.substring(column, 1 + 3 * k, 3) for k in range(digits)]


def bounded_buckets(
    df: DataFrame,
    group: Sequence[str],
    digits: Sequence[Column],
    rows: int = BUCKET_ROWS,
    bucket: str = "_radix",
) -> DataFrame:
    """``df`` with a bucket of at most ``rows`` rows of its group, not decreasing along ``digits``.

    ``digits`` tell the position of a row, coarse to fine. Rows are counted by group and
    first digit; only where a count exceeds ``rows`` is the next digit looked at, and so
    on, so a group of ordinary size costs one counter and a crowded stretch of any group,
    however short, is cut until it fits. Counts are combined before they are shuffled, and
    what is joined back are the crowded prefixes alone. Rows that agree in all digits
    stay together. Null positions are a bucket of their own, which is not cut.
    """
    names = [f"_digit{k}" for k in range(len(digits))]
    out = df.withColumn("_group", F.struct(*group) if group else F.struct(F.lit(0)))
    out = out.withColumn(names[0], digits[0])
    inside = out
    used = 1
    while used < len(digits):
        prefix = ["_group", *names[:used]]
        sizes = inside.groupBy(*prefix).agg(F.count(F.lit(1)).alias("_n"))
        crowded = staged(sizes.where(F.col("_n") > rows).select(*prefix, F.lit(True).alias("_crowded")), "crowded")
        if crowded.isEmpty():
            break
        out = out.join(crowded, prefix, "left").withColumn(names[used], F.when(F.col("_crowded"), digits[used]))
        out = out.drop("_crowded")
        used += 1
        inside = out.where(F.col(names[used - 1]).isNotNull())
    return out.withColumn(bucket, F.struct(*names[:used])).select(*df.columns, bucket)


def ranked(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    rank: str = "rank",
    size: str | None = None,
) -> DataFrame:
    """Exact 1-based row number within ``group`` without one task per group.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside
    (group, bucket); bucket sizes are counted with a map-side combine and turned
    into start offsets, which are joined back on the keys the rows are already
    partitioned by. A group that holds a third of all rows is therefore spread
    over its buckets. With ``group`` empty the rank is global. ``size`` adds the
    row count of the group. Null is a group value like any other.
    """
    rows = df.withColumn("_bucket", bucket)
    # structs compare null fields as equal, so rows of a null group find their offsets
    rows = rows.withColumn("_group", F.struct(*group) if group else F.struct(F.lit(0)))
    rows = rows.withColumn("_slice", F.struct("_bucket"))
    group = ["_group"]
    per_bucket = rows.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *group,
        "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_size"),
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    out = (
        rows.withColumn("_within", F.row_number().over(inside))
        .join(offsets, [*group, "_slice"])
        .withColumn(rank, F.col("_before") + F.col("_within"))
    )
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.select(*df.columns, rank, *([size] if size else []))


def first_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    n: int,
    rank: str = "pkt_seq",
    salt: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of every group with their row number.

    The optimizer already cuts every input partition to ``n`` rows per group
    before the shuffle, so a group never sends more than ``n`` rows per input
    partition to one task. For a large ``n`` and a group found in all partitions
    that is still much, so the survivors are first cut per (group, salt) and the
    last task sees at most ``salt * n`` rows of a group. ``salt=1`` turns the extra
    shuffle off; by default it is off up to ``n = 512``.
    """
    if salt is None:
        salt = 1 if n <= 512 else -(-n // 128)
    if salt > 1:
        part = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salt)))
            .withColumn("_part_rank", F.row_number().over(part))
            .filter(F.col("_part_rank") <= n)
            .drop("_salt", "_part_rank")
        )
    whole = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)
