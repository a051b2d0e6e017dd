"""Per-flow features: length and direction sequences, 54 statistics, byte images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom import profiles as fixed
from flowloom.functions import images
from flowloom.functions import packets as P
from flowloom.functions import stats as S
from flowloom.functions.sequences import fixed_length, ordered_values
from flowloom.operators.flows import FLOW_KEY, at_least, first_packets, flow_clients, number_packets
from flowloom.operators.ranking import first_rows
from flowloom.profiles import FlowProfile

DECILES = (10, 20, 30, 40, 50, 60, 70, 80, 90)
BLOCK_STATS = (
    ["count", "min", "max", "mean", "std", "var", "skew", "kurt", "mad"] + [f"p{p}" for p in DECILES]
)
DIRECTIONS = ("in", "out", "bi")
# above this many packets a flow's lengths are counted, not listed
LONG_FLOW = 5000
FEATURE_NAMES = [f"{d}_{s}" for d in DIRECTIONS for s in BLOCK_STATS]


def sequences(cut: DataFrame, value: Column, min_packets: int, name: str) -> DataFrame:
    """One ordered array per flow from packets already cut to a bounded number."""
    packed = F.collect_list(F.struct(F.col("pkt_seq").alias("k"), value.alias("v")))
    return (
        cut.groupBy(*FLOW_KEY)
        .agg(packed.alias("_packed"))
        .filter(F.size("_packed") >= min_packets)
        .select(*FLOW_KEY, ordered_values(F.col("_packed")).alias(name))
    )


def length_sequences(
    keyed: DataFrame,
    profile: FlowProfile,
    min_packets: int = fixed.LENGTHS_MIN,
    max_packets: int = fixed.LENGTHS_MAX,
    limit: int = fixed.MTU,
) -> DataFrame:
    cut = first_packets(keyed, profile, max_packets)
    return sequences(cut, P.signed_length(limit).cast("smallint"), min_packets, "lengths")


def direction_sequences(
    keyed: DataFrame,
    profile: FlowProfile,
    min_packets: int = fixed.DIRECTIONS_MIN,
    max_packets: int = fixed.DIRECTIONS_MAX,
) -> DataFrame:
    cut = first_packets(keyed, profile, max_packets)
    return sequences(cut, F.col("dir").cast("tinyint"), min_packets, "directions")


def stats_packets(
    keyed: DataFrame,
    profile: FlowProfile,
    min_packets: int = fixed.STATS_MIN,
    max_packets: int = fixed.STATS_MAX,
) -> DataFrame:
    """The packets the statistics are taken over: at most ``max_packets`` per flow."""
    if profile.proportional:
        return proportional_packets(keyed, profile, min_packets, max_packets)
    return at_least(first_packets(keyed, profile, max_packets), FLOW_KEY, min_packets)


def proportional_packets(
    keyed: DataFrame, profile: FlowProfile, min_packets: int, max_packets: int
) -> DataFrame:
    """Over-long flows keep ``int(max * out / total)`` outgoing packets and the rest incoming.

    Direction counts are a map-side combined aggregate; the rows kept for the
    join are already cut to ``max_packets`` per flow and direction.
    """
    if profile.direction != "canonical":
        raise ValueError("proportional truncation is defined for the canonical direction rule")
    out = F.col("dir") == profile.outgoing
    counts = (
        keyed.groupBy(*FLOW_KEY)
        .agg(F.count_if(out).alias("_out"), F.count(F.lit(1)).alias("_total"))
        .filter(F.col("_total") >= min_packets)
    )
    quota_out = F.floor(F.lit(max_packets) * (F.col("_out") / F.col("_total")))
    counts = counts.select(
        *FLOW_KEY,
        (F.col("_total") > max_packets).alias("_long"),
        quota_out.alias("_max_out"),
        (F.lit(max_packets) - quota_out).alias("_max_in"),
    )
    if max_packets > LONG_FLOW:
        cut = number_packets(keyed, profile, group=[*FLOW_KEY, "dir"], rank="_dir_seq")
        cut = cut.filter(F.col("_dir_seq") <= max_packets)
    else:
        cut = first_rows(keyed, [*FLOW_KEY, "dir"], profile.order, max_packets, "_dir_seq")
    quota = F.when(out, F.col("_max_out")).otherwise(F.col("_max_in"))
    return (
        cut.join(counts, FLOW_KEY)
        .filter(~F.col("_long") | (F.col("_dir_seq") <= quota))
        .drop("_long", "_max_out", "_max_in", "_dir_seq")
    )


def _moments(name: str, x: str, profile: FlowProfile) -> list[str]:
    """Aggregates of one direction over the SQL value ``x`` (null outside it)."""
    # both shape statistics are null for constant input
    return [
        f"double(count({x})) AS {name}_count",
        f"coalesce(min({x}), 0D) AS {name}_min",
        f"coalesce(max({x}), 0D) AS {name}_max",
        f"coalesce(avg({x}), 0D) AS {name}_mean",
        f"coalesce(stddev_pop({x}), 0D) AS {name}_std",
        f"coalesce(var_pop({x}), 0D) AS {name}_var",
        f"if(count({x}) >= 3, coalesce(skewness({x}), 0D), 0D) AS {name}_skew",
        f"if(count({x}) >= {profile.kurtosis_min_n}, coalesce(kurtosis({x}), 0D), 0D) AS {name}_kurt",
        f"sort_array(collect_list({x})) AS _{name}",
    ]


def statistics(cut: DataFrame, profile: FlowProfile, keys: list[str] | None = None) -> DataFrame:
    """54 columns per flow, one aggregation pass; an absent direction is all zeros.

    Percentiles and the median absolute deviation come from the sorted lengths,
    which the truncation has bounded, so no second pass over the packets is needed.
    """
    keys = keys or FLOW_KEY
    length, outgoing = "double(frame_len)", f"dir = {profile.outgoing}"
    inputs = {
        "in": f"if({outgoing}, NULL, {length})",
        "out": f"if({outgoing}, {length}, NULL)",
        "bi": length,
    }
    aggregates = [e for d, x in inputs.items() for e in _moments(d, x, profile)]
    grouped = cut.groupBy(*keys).agg(*[F.expr(e) for e in aggregates])
    ordered = [f"{S.mad_sql(f'_{d}')} AS {d}_mad" for d in DIRECTIONS]
    ordered += [f"{S.percentiles_sql(f'_{d}', DECILES)} AS _{d}_deciles" for d in DIRECTIONS]
    spread = {f"{d}_p{p}": f"get(_{d}_deciles, {i})" for d in DIRECTIONS for i, p in enumerate(DECILES)}
    named = [f"coalesce({spread.get(c, c)}, 0D) AS {c}" for c in FEATURE_NAMES]
    return grouped.selectExpr("*", *ordered).selectExpr(*keys, *named)


def statistics_by_counts(
    packets: DataFrame, profile: FlowProfile, min_packets: int = 1, keys: list[str] | None = None
) -> DataFrame:
    """The 54 columns of `statistics` for flows of any length.

    Lengths are small integers, so a flow is told by how often each occurs: packets are
    counted by flow and length before anything is shuffled, and from then on a flow has as
    many rows as it has different lengths. Order statistics are read off running counts;
    for the median absolute deviation they run once more in order of the distance from
    the median. No array of a flow's packets is ever built.
    """
    keys = keys or FLOW_KEY
    outgoing = F.coalesce(F.col("dir") == profile.outgoing, F.lit(False))
    known = F.col("frame_len").isNotNull()
    rows = packets.groupBy(*keys, F.col("frame_len").cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_packets"),
        F.count_if(known & ~outgoing).alias("_in"),
        F.count_if(known & outgoing).alias("_out"),
        F.count_if(known).alias("_bi"),
    )
    flow = Window.partitionBy(*keys)
    until = (Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "_total": F.sum("_packets").over(flow),
            **{f"_{d}_n": F.sum(f"_{d}").over(flow) for d in DIRECTIONS},
            **{f"_{d}_sum": F.sum(F.col(f"_{d}") * F.col("_v")).over(flow) for d in DIRECTIONS},
            **{f"_{d}_upto": F.sum(f"_{d}").over(flow.orderBy("_v").rowsBetween(*until)) for d in DIRECTIONS},
        }
    ).filter(F.col("_total") >= min_packets)
    middle = {f"_{d}_mid": S.percentile_of_counts("_v", f"_{d}_upto", f"_{d}_n", 0.5, flow) for d in DIRECTIONS}
    rows = rows.withColumns(middle)
    rows = rows.withColumns(
        {f"_{d}_off": F.when(F.col(f"_{d}") > 0, F.abs(F.col("_v") - F.col(f"_{d}_mid"))) for d in DIRECTIONS}
    )
    rows = rows.withColumns(
        {f"_{d}_near": F.sum(f"_{d}").over(flow.orderBy(f"_{d}_off", "_v").rowsBetween(*until)) for d in DIRECTIONS}
    )
    aggregates = [e for d in DIRECTIONS for e in _moments_of_counts(d, profile)]
    grouped = rows.groupBy(*keys).agg(*aggregates)
    return grouped.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURE_NAMES])


def _moments_of_counts(name: str, profile: FlowProfile) -> list[Column]:
    """Aggregates of one direction over rows of a length and how often it occurs."""
    n, value, times = F.max(f"_{name}_n").cast("double"), F.col("_v"), F.col(f"_{name}")
    mean = F.try_divide(F.col(f"_{name}_sum"), F.col(f"_{name}_n"))
    present = F.when(times > 0, value)
    off = {p: F.try_divide(F.sum(F.when(times > 0, times * F.pow(value - mean, p))), n) for p in (2, 3, 4)}
    varies = F.min(present) < F.max(present)
    skew = F.when(varies & (n >= 3), F.try_divide(off[3], F.pow(off[2], 1.5)))
    kurt = F.when(varies & (n >= profile.kurtosis_min_n), F.try_divide(off[4], off[2] * off[2]) - 3)
    found = {
        "count": n,
        "min": F.min(present),
        "max": F.max(present),
        "mean": F.max(mean),
        "std": F.sqrt(off[2]),
        "var": off[2],
        "skew": skew,
        "kurt": kurt,
        "mad": S.percentile_of_counts(f"_{name}_off", f"_{name}_near", f"_{name}_n", 0.5),
        **{f"p{p}": S.percentile_of_counts("_v", f"_{name}_upto", f"_{name}_n", p / 100) for p in DECILES},
    }
    return [column.alias(f"{name}_{stat}") for stat, column in found.items()]


def flow_statistics(
    keyed: DataFrame,
    profile: FlowProfile,
    min_packets: int = fixed.STATS_MIN,
    max_packets: int | None = fixed.STATS_MAX,
) -> DataFrame:
    """54 columns per flow of at least ``min_packets``, over its first ``max_packets`` or all packets.

    Up to `LONG_FLOW` packets the lengths of a flow are sorted as an array; beyond, and
    without a limit, they are counted.
    """
    if max_packets is None:
        return statistics_by_counts(keyed, profile, min_packets)
    if max_packets <= LONG_FLOW:
        return statistics(stats_packets(keyed, profile, min_packets, max_packets), profile)
    if profile.proportional:
        return statistics_by_counts(proportional_packets(keyed, profile, min_packets, max_packets), profile)
    first = number_packets(keyed, profile).filter(F.col("pkt_seq") <= max_packets)
    if profile.direction == "client":
        sender = flow_clients(keyed, profile.order)
        forward = F.col("src_ip_text") == F.col("client_ip")
        sign = F.when(forward, F.lit(profile.outgoing)).otherwise(F.lit(-profile.outgoing))
        first = first.join(sender, FLOW_KEY).withColumn("dir", sign)
    return statistics_by_counts(first, profile, min_packets)


def flow_images(
    keyed: DataFrame, profile: FlowProfile, n_packets: int = fixed.IMAGE_PACKETS
) -> DataFrame:
    """1600-byte image of the first five packets; shorter flows give none.

    Headers and payload are cut to the 320 bytes the image holds before anything
    is shuffled.
    """
    block = images.packet_block(F.col("ip_header"), F.col("l4_header"), F.col("payload"))
    slim = keyed.select(*FLOW_KEY, *profile.order, block.alias("_block"))
    cut = first_rows(slim, FLOW_KEY, profile.order, n_packets)
    packed = F.collect_list(F.struct(F.col("pkt_seq").alias("k"), F.col("_block").alias("v")))
    return (
        cut.groupBy(*FLOW_KEY)
        .agg(packed.alias("_packed"))
        .filter(F.size("_packed") >= n_packets)
        .select(*FLOW_KEY, images.image_from_blocks(ordered_values(F.col("_packed"))).alias("image"))
    )


def hex_images(blocks: DataFrame, keys: list[str], block: Column, order: str = "pkt_seq") -> DataFrame:
    """Hex image per key from at most five block rows; missing packets are zero."""
    packed = F.collect_list(F.struct(F.col(order).alias("k"), block.alias("v")))
    return blocks.groupBy(*keys).agg(
        images.image_from_blocks_hex(ordered_values(packed)).alias("image_hex")
    )


def pad_batches(
    seqs: DataFrame, value: str, batch: str, length: str = "true_length"
) -> DataFrame:
    """Zero-pad every sequence to the longest of its batch and keep its own length."""
    longest = F.max(F.size(value)).over(Window.partitionBy(batch))
    return (
        seqs.withColumn("_longest", longest)
        .withColumn(length, F.size(value))
        .withColumn(value, fixed_length(F.col(value), F.col("_longest")))
        .drop("_longest")
    )
