"""Extraction counts per capture and per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import packets as P
from flowloom.operators.flows import FLOW_KEY, key_flows
from flowloom.profiles import FlowProfile


def packet_funnel(packets: DataFrame, profile: FlowProfile) -> DataFrame:
    """Packets per capture that reach each stage; one pass, combined map-side."""
    ip = P.is_ip(profile.ip_versions)
    transport = ip & P.is_transport()
    return packets.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.count_if(ip).alias("ip_packets"),
        F.count_if(transport).alias("tcp_udp_packets"),
        F.count_if(P.accepted(profile)).alias("kept_packets"),
    )


def flow_funnel(packets: DataFrame, profile: FlowProfile, min_packets: int) -> DataFrame:
    """Packet stages joined with flows before and after the minimum-size filter."""
    keyed = key_flows(packets.filter(P.accepted(profile)), profile)
    per_flow = keyed.groupBy(*FLOW_KEY).agg(F.count(F.lit(1)).alias("_n"))
    per_capture = per_flow.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("flows_before_filter"),
        F.count_if(F.col("_n") >= min_packets).alias("flows_after_filter"),
    )
    zero = {"flows_before_filter": 0, "flows_after_filter": 0}
    return packet_funnel(packets, profile).join(per_capture, "capture_id", "left").fillna(zero)


def files_per_class(captures: DataFrame) -> DataFrame:
    return captures.groupBy("label_id").agg(F.count(F.lit(1)).alias("n_files"))


def without_flows(captures: DataFrame, flows: DataFrame) -> DataFrame:
    """Captures that gave no flow at all."""
    return captures.join(flows.select("capture_id").distinct(), "capture_id", "left_anti")


def failed_per_class(captures: DataFrame, flows: DataFrame) -> DataFrame:
    return without_flows(captures, flows).groupBy("label_id").agg(F.count(F.lit(1)).alias("n_failed"))


def first_failures(captures: DataFrame, flows: DataFrame, n: int = 5) -> DataFrame:
    return without_flows(captures, flows).orderBy("path").limit(n)
