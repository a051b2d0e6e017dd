"""Packets to bidirectional flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import packets as P
from flowloom.functions.text import flow_name
from flowloom.operators.ranking import BUCKET_ROWS, block_bucket, bounded_buckets, first_rows, long_digits, ranked
from flowloom.profiles import FlowProfile

FLOW_KEY = ["capture_id", "proto", "ep_a", "port_a", "ep_b", "port_b"]


def select_packets(packets: DataFrame, profile: FlowProfile) -> DataFrame:
    return packets.filter(P.accepted(profile))


def key_flows(packets: DataFrame, profile: FlowProfile) -> DataFrame:
    """Add the flow key columns; both directions of a conversation share one key.

    Flows never cross captures, so ``capture_id`` is part of the key. Under the
    canonical rule the direction follows from the key alone and is added too.
    """
    src, dst = ("src_ip", "dst_ip") if profile.key_order == "numeric" else ("src_ip_text", "dst_ip_text")
    keyed = packets.withColumn("_fwd", P.in_key_order(profile))
    forward = F.col("_fwd")
    keyed = keyed.select(
        *packets.columns,
        F.when(forward, F.col(src)).otherwise(F.col(dst)).alias("ep_a"),
        F.when(forward, F.col("sport")).otherwise(F.col("dport")).alias("port_a"),
        F.when(forward, F.col(dst)).otherwise(F.col(src)).alias("ep_b"),
        F.when(forward, F.col("dport")).otherwise(F.col("sport")).alias("port_b"),
        "_fwd",
    )
    if profile.direction == "canonical":
        keyed = keyed.withColumn(
            "dir", F.when(F.col("_fwd"), F.lit(profile.outgoing)).otherwise(F.lit(-profile.outgoing))
        )
    return keyed.drop("_fwd")


def flow_id() -> Column:
    """The flow key as printable text; binary addresses are written in hexadecimal."""
    parts = [
        F.expr(f"CASE WHEN typeof({c}) = 'binary' THEN hex({c}) ELSE CAST({c} AS STRING) END") for c in FLOW_KEY
    ]
    return F.concat_ws(":", *parts)


def flow_packets(packets: DataFrame, profile: FlowProfile) -> DataFrame:
    return key_flows(select_packets(packets, profile), profile)


def client_directions(df: DataFrame, order: Sequence[str], outgoing: int) -> DataFrame:
    """Sign by sender: ``outgoing`` for the host that sent the flow's first packet.

    Meant for packets already cut by `first_packets`: the first packet survives
    any cut, and the window then sorts a bounded number of rows per flow with the
    partitioning that is already in place.
    """
    ordered = Window.partitionBy(*FLOW_KEY).orderBy(*order)
    return (
        df.withColumn("_client", F.first("src_ip_text").over(ordered))
        .withColumn(
            "dir",
            F.when(F.col("src_ip_text") == F.col("_client"), F.lit(outgoing)).otherwise(F.lit(-outgoing)),
        )
        .drop("_client")
    )


def flow_clients(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sender of each flow's first packet, as an aggregate with map-side combine."""
    return df.groupBy(*FLOW_KEY).agg(
        F.min_by("src_ip_text", F.struct(*[F.col(c) for c in order])).alias("client_ip")
    )


def first_packets(
    keyed: DataFrame, profile: FlowProfile, n: int, salt: int | None = None
) -> DataFrame:
    """First ``n`` packets of every flow with ``pkt_seq`` and ``dir``."""
    cut = first_rows(keyed, FLOW_KEY, profile.order, n, "pkt_seq", salt)
    if profile.direction == "client":
        cut = client_directions(cut, profile.order, profile.outgoing)
    return cut


def time_positions(tie: str = "pkt_no") -> list[Column]:
    """Place of a packet in time order as digits, coarse to fine; ``tie`` decides within a microsecond."""
    return [*long_digits(P.micros("ts")), *long_digits(F.col(tie).cast("bigint"))]


def number_packets(
    keyed: DataFrame,
    profile: FlowProfile,
    rows: int = BUCKET_ROWS,
    group: Sequence[str] = tuple(FLOW_KEY),
    rank: str = "pkt_seq",
) -> DataFrame:
    """Position of every packet in its flow, for flows of any length and density.

    The work is split into blocks of positions or stretches of time of at most ``rows``
    packets of a flow, however many of them a second holds.
    """
    if profile.time_ordered:
        cut = bounded_buckets(keyed, group, time_positions(), rows)
        return ranked(cut, group, profile.order, F.col("_radix"), rank).drop("_radix")
    return ranked(keyed, group, profile.order, block_bucket("pkt_no", rows), rank)


def at_least(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Rows whose group has at least ``k`` rows.

    ``df`` must already be cut to a bounded number of rows per group (``k`` or
    more), so that the count is over few rows.
    """
    return (
        df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .filter(F.col("_n") >= k)
        .drop("_n")
    )


def flow_sizes(keyed: DataFrame, min_packets: int = 1) -> DataFrame:
    """One row per flow with its packet and byte counts (partial sums before the shuffle)."""
    sizes = keyed.groupBy(*FLOW_KEY).agg(
        F.count(F.lit(1)).alias("n_packets"), F.sum("frame_len").alias("n_bytes")
    )
    return sizes.filter(F.col("n_packets") >= min_packets)


def flow_names(keyed: DataFrame, captures: DataFrame, block_rows: int = 65536) -> DataFrame:
    """``<capture file>_<ordinal>`` per flow, numbered by first packet within the capture."""
    flows = keyed.groupBy(*FLOW_KEY).agg(F.min("pkt_no").alias("first_pkt"))
    numbered = ranked(
        flows, ["capture_id"], ["first_pkt"], block_bucket("first_pkt", block_rows), "_ordinal"
    )
    return (
        numbered.join(captures.select("capture_id", "path"), "capture_id")
        .withColumn("flow_name", flow_name(F.col("path"), F.col("_ordinal") - 1))
        .drop("_ordinal", "path")
    )


def capture_sequences(packets: DataFrame, n: int, limit: int) -> DataFrame:
    """First ``n`` IPv4 packets of each capture, signed by the capture's first sender."""
    cut = first_rows(packets.filter(P.is_ip((4,))), ["capture_id"], ["pkt_no"], n)
    ordered = Window.partitionBy("capture_id").orderBy("pkt_no")
    sign = F.when(F.col("src_ip_text") == F.first("src_ip_text").over(ordered), 1).otherwise(-1)
    return cut.withColumn("v", sign * P.capped_length(limit))
