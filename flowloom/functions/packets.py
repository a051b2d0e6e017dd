"""Predicates and scalar expressions over one packet row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.profiles import MTU, TCP, UDP, FlowProfile


def is_ip(versions: Sequence[int] | None = None) -> Column:
    version = F.col("ip_version")
    if versions is None:
        return version.isNotNull()
    return version.isin(*versions)


def is_transport() -> Column:
    return F.col("proto").isin(TCP, UDP)


def touches_udp_port(ports: Sequence[int]) -> Column:
    return (F.col("proto") == UDP) & (F.col("sport").isin(*ports) | F.col("dport").isin(*ports))


def touches_address(addresses: Sequence[str]) -> Column:
    return F.col("src_ip_text").isin(*addresses) | F.col("dst_ip_text").isin(*addresses)


def has_payload() -> Column:
    return F.col("payload_len") > 0


def accepted(profile: FlowProfile) -> Column:
    """Every packet filter of a profile as one predicate, so it can reach the scan."""
    keep = is_ip(profile.ip_versions) & is_transport()
    if profile.drop_udp_ports:
        keep = keep & ~touches_udp_port(profile.drop_udp_ports)
    if profile.drop_addresses:
        keep = keep & ~touches_address(profile.drop_addresses)
    if profile.payload_only:
        keep = keep & has_payload()
    return keep


def capped_length(limit: int = MTU) -> Column:
    return F.least(F.col("frame_len"), F.lit(limit))


def signed_length(limit: int = MTU) -> Column:
    return F.col("dir") * capped_length(limit)


def in_key_order(profile: FlowProfile) -> Column:
    """True where the sender is the first endpoint of the flow key."""
    if profile.key_order == "numeric":
        src, dst = F.col("src_ip"), F.col("dst_ip")
        return (src < dst) | ((src == dst) & (F.col("sport") <= F.col("dport")))
    src, dst = F.col("src_ip_text"), F.col("dst_ip_text")
    return (src < dst) | ((src == dst) & (F.col("sport") < F.col("dport")))


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))
