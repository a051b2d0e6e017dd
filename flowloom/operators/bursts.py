"""Splitting flows at silent gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.packets import micros
from flowloom.operators.flows import FLOW_KEY, time_positions
from flowloom.operators.ranking import BUCKET_ROWS, bounded_buckets

BURST_GAP = 1.0
FLOW_TIMEOUT = 60.0


def split_at_gaps(
    packets: DataFrame,
    gap_seconds: float,
    keys: Sequence[str] = tuple(FLOW_KEY),
    tie: str = "pkt_no",
    out: str = "burst",
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Number the bursts of every key from 0; a gap of at least ``gap_seconds`` starts one.

    The packets of a key are cut into stretches of time of at most ``rows`` packets, so
    that no task sorts more of a key, however long or dense it is and whatever the gap.
    A stretch is summed up as its first and last time and the bursts that start inside
    it; these summaries are merged in order of time, one row per stretch, and tell each
    stretch the number of its first burst. Packets without a time are a stretch of their
    own, before all others and without gaps.
    """
    keys = list(keys)
    gap = int(gap_seconds * 1_000_000)
    cut = bounded_buckets(packets, keys, time_positions(tie), rows, "_stretch")
    # structs compare null fields as equal, so rows of a null key find their stretch
    timed = cut.withColumn("_t", micros("ts")).withColumn("_key", F.struct(*keys))
    inside = Window.partitionBy("_key", "_stretch").orderBy("_t", tie)
    starts = F.when(F.col("_t") - F.lag("_t").over(inside) >= gap, 1).otherwise(0)
    local = timed.withColumn("_start", starts).withColumn(
        "_local", F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    stretches = local.groupBy("_key", "_stretch").agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.sum("_start").alias("_starts")
    )
    across = Window.partitionBy("_key").orderBy("_stretch")
    fresh = F.when(F.col("_first") - F.lag("_last").over(across) >= gap, 1).otherwise(0)
    so_far = F.sum(F.col("_fresh") + F.col("_starts")).over(across.rowsBetween(Window.unboundedPreceding, 0))
    bases = stretches.withColumn("_fresh", fresh).select(
        "_key", "_stretch", (so_far - F.col("_starts")).alias("_base")
    )
    return (
        local.join(bases, ["_key", "_stretch"])
        .withColumn(out, F.col("_base") + F.col("_local"))
        .select(*packets.columns, out)
    )


def burst_summary(split: DataFrame, keys: Sequence[str] = tuple(FLOW_KEY), burst: str = "burst") -> DataFrame:
    return split.groupBy(*keys, burst).agg(
        F.count(F.lit(1)).alias("n_packets"),
        F.sum("frame_len").alias("n_bytes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
