"""Packet filters, keys, directions and flow sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.registry import big, flow_key_id, query, r6
from flowloom.functions import packets as P
from flowloom.operators import bursts, flows, funnel
from flowloom.operators.features import proportional_packets
from flowloom.profiles import (
    MDNS_PORT,
    PROCESSOR_DIRECTIONS,
    PROCESSOR_IMAGES,
    PROCESSOR_LENGTHS,
    PROCESSOR_STATS,
    UNIFIED,
)

U = ("flow_packets",)
C = ("client_packets",)


def _kept(q, predicate):
    return q.packets().filter(predicate).select("pkt_no", *big("frame_len", "payload_len"))


def _kept_sql(condition):
    return f"SELECT pkt_id AS pkt_no, frame_len, payload_len FROM packets WHERE {condition}"


@query("p1_ip_packets", _kept_sql("ip_version IS NOT NULL"), ("packets",))
def _(q):
    return _kept(q, P.is_ip())


@query("p2_tcp_udp_packets", _kept_sql("proto IN (6, 17)"), ("packets",))
def _(q):
    return _kept(q, P.is_transport())


@query(
    "p3_without_mdns",
    _kept_sql("NOT (proto = 17 AND (sport = 5353 OR dport = 5353))"),
    ("packets",),
)
def _(q):
    return _kept(q, ~P.touches_udp_port((MDNS_PORT,)))


@query(
    "p4_without_multicast",
    _kept_sql("src_ip_text NOT IN ('10.0.0.251') AND dst_ip_text NOT IN ('10.0.0.251')"),
    ("packets",),
)
def _(q):
    return _kept(q, ~P.touches_address(("10.0.0.251",)))


@query("p5_payload_packets", _kept_sql("payload_len > 0"), ("packets",))
def _(q):
    return _kept(q, P.has_payload())


@query(
    "p6_flow_key_numeric",
    "SELECT pkt_id AS pkt_no, flow_id FROM flow_packets",
    U,
)
def _(q):
    return q.keyed(UNIFIED).select("pkt_no", flow_key_id())


@query("p7_flow_key_text", "SELECT pkt_id AS pkt_no, flow_id FROM client_packets", C)
def _(q):
    return q.keyed(PROCESSOR_STATS).select("pkt_no", flow_key_id())


@query("p8_direction_canonical", "SELECT pkt_id AS pkt_no, CAST(dir AS BIGINT) AS dir FROM flow_packets", U)
def _(q):
    return q.keyed(UNIFIED).select("pkt_no", *big("dir"))


@query(
    "p9_direction_canonical_negated",
    """SELECT pkt_id AS pkt_no, flow_id, CAST(CASE WHEN src_ip_text = ep_a AND sport = port_a THEN -1 ELSE 1 END AS BIGINT) AS dir
FROM client_packets""",
    C,
)
def _(q):
    return q.keyed(PROCESSOR_IMAGES).select("pkt_no", flow_key_id(), *big("dir"))


@query(
    "p10_direction_by_client",
    """SELECT pkt_id AS pkt_no, CAST(pkt_seq AS BIGINT) AS pkt_seq, CAST(-out_sign AS BIGINT) AS dir
FROM client_packets WHERE pkt_seq <= 40""",
    C,
)
def _(q):
    cut = flows.first_packets(q.keyed(PROCESSOR_STATS), PROCESSOR_STATS, 40)
    return cut.select("pkt_no", *big("pkt_seq", "dir"))


@query(
    "p11_capture_sequences",
    """SELECT capture_id, CAST(rn AS BIGINT) AS pkt_seq,
 CAST(CASE WHEN src_ip_text = first_src THEN 1 ELSE -1 END * least(frame_len, 1500) AS BIGINT) AS v
FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY pkt_id) AS rn,
  first_value(src_ip_text) OVER (PARTITION BY capture_id ORDER BY pkt_id) AS first_src
 FROM packets WHERE ip_version = 4) t WHERE rn <= 100""",
    ("packets",),
)
def _(q):
    return flows.capture_sequences(q.packets(), 100, 1500).select("capture_id", *big("pkt_seq", "v"))


@query(
    "p12_min_packets_per_flow",
    """SELECT flow_id, count(*) AS n_packets, CAST(sum(frame_len) AS BIGINT) AS n_bytes
FROM flow_packets GROUP BY flow_id HAVING count(*) >= 10""",
    U,
)
def _(q):
    return flows.flow_sizes(q.keyed(), 10).select(flow_key_id(), *big("n_packets", "n_bytes"))


@query(
    "p14_capped_length",
    "SELECT pkt_id AS pkt_no, least(frame_len, 1500) AS capped FROM packets",
    ("packets",),
)
def _(q):
    return q.packets().select("pkt_no", P.capped_length().cast("bigint").alias("capped"))


@query(
    "p15_signed_length",
    "SELECT pkt_id AS pkt_no, CAST(dir * least(frame_len, 1500) AS BIGINT) AS v FROM flow_packets",
    U,
)
def _(q):
    return q.keyed().select("pkt_no", P.signed_length().cast("bigint").alias("v"))


@query(
    "p25_flow_names",
    """SELECT f.flow_id, concat_ws('_', regexp_extract(c.path, '[^/]+$'), CAST(f.ordinal AS VARCHAR)) AS flow_name
FROM (SELECT flow_id, capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY min(pkt_id)) - 1 AS ordinal
 FROM flow_packets GROUP BY flow_id, capture_id) f JOIN captures c ON f.capture_id = c.capture_id""",
    ("flow_packets", "captures"),
)
def _(q):
    named = flows.flow_names(q.keyed(), q.captures())
    return named.select(flow_key_id(), "flow_name")


@query(
    "g1_flows",
    "SELECT flow_id, count(*) AS n_packets, CAST(sum(frame_len) AS BIGINT) AS n_bytes FROM flow_packets GROUP BY flow_id",
    U,
)
def _(q):
    return flows.flow_sizes(q.keyed()).select(flow_key_id(), *big("n_packets", "n_bytes"))


@query(
    "g1_flows_text_key",
    "SELECT flow_id, count(*) AS n_packets, CAST(sum(frame_len) AS BIGINT) AS n_bytes FROM client_packets GROUP BY flow_id",
    C,
)
def _(q):
    sizes = flows.flow_sizes(q.keyed(PROCESSOR_LENGTHS))
    return sizes.select(flow_key_id(), *big("n_packets", "n_bytes"))


@query(
    "g2_first_packets",
    """SELECT flow_id, pkt_id AS pkt_no, CAST(pkt_seq AS BIGINT) AS pkt_seq, CAST(dir AS BIGINT) AS dir, frame_len
FROM flow_packets WHERE pkt_seq <= 40""",
    U,
)
def _(q):
    cut = flows.first_packets(q.keyed(), UNIFIED, 40)
    return cut.select(flow_key_id(), "pkt_no", *big("pkt_seq", "dir", "frame_len"))


@query(
    "g2_first_packets_salted",
    """SELECT flow_id, pkt_id AS pkt_no, CAST(pkt_seq AS BIGINT) AS pkt_seq, CAST(dir AS BIGINT) AS dir, frame_len
FROM flow_packets WHERE pkt_seq <= 40""",
    U,
)
def _(q):
    cut = flows.first_packets(q.keyed(), UNIFIED, 40, salt=8)
    return cut.select(flow_key_id(), "pkt_no", *big("pkt_seq", "dir", "frame_len"))


@query(
    "w1_sequence_number_capture_order",
    "SELECT pkt_id AS pkt_no, CAST(pkt_seq AS BIGINT) AS pkt_seq FROM flow_packets",
    U,
)
def _(q):
    return flows.number_packets(q.keyed(), UNIFIED).select("pkt_no", *big("pkt_seq"))


@query(
    "w1_sequence_number_time_order",
    "SELECT pkt_id AS pkt_no, CAST(pkt_seq AS BIGINT) AS pkt_seq FROM client_packets",
    C,
)
def _(q):
    numbered = flows.number_packets(q.keyed(PROCESSOR_STATS), PROCESSOR_STATS)
    return numbered.select("pkt_no", *big("pkt_seq"))


@query(
    "w2_client_address",
    "SELECT flow_id, min(client) AS client_ip FROM client_packets GROUP BY flow_id",
    C,
)
def _(q):
    clients = flows.flow_clients(q.keyed(PROCESSOR_STATS), PROCESSOR_STATS.order)
    return clients.select(flow_key_id(), "client_ip")


@query(
    "w3_proportional_truncation",
    """SELECT flow_id, pkt_id AS pkt_no, CAST(dir AS BIGINT) AS dir FROM (
 SELECT *, row_number() OVER (PARTITION BY flow_id, dir ORDER BY pkt_id) AS dir_seq,
  count(*) OVER (PARTITION BY flow_id) AS total,
  sum(CASE WHEN dir = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id) AS outs FROM flow_packets) t
WHERE total >= 7 AND (total <= 40 OR dir_seq <=
 CASE WHEN dir = 1 THEN floor(40 * (CAST(outs AS DOUBLE) / total)) ELSE 40 - floor(40 * (CAST(outs AS DOUBLE) / total)) END)""",
    U,
)
def _(q):
    cut = proportional_packets(q.keyed(), UNIFIED, 7, 40)
    return cut.select(flow_key_id(), "pkt_no", *big("dir"))


@query(
    "g3_g4_flow_moments",
    """SELECT flow_id, count(*) AS n, min(frame_len) AS min_len, max(frame_len) AS max_len,
 round(avg(frame_len), 6) AS mean_len, round(stddev_pop(frame_len), 6) AS std_len, round(var_pop(frame_len), 6) AS var_len
FROM flow_packets GROUP BY flow_id HAVING count(*) >= 7""",
    U,
)
def _(q):
    x = F.col("frame_len")
    grouped = q.keyed().groupBy(*flows.FLOW_KEY).agg(
        F.count(x).alias("n"),
        F.min(x).alias("min_len"),
        F.max(x).alias("max_len"),
        r6(F.avg(x)).alias("mean_len"),
        r6(F.stddev_pop(x)).alias("std_len"),
        r6(F.var_pop(x)).alias("var_len"),
    )
    return grouped.filter("n >= 7").select(
        flow_key_id(), *big("n", "min_len", "max_len"), "mean_len", "std_len", "var_len"
    )


_FUNNEL = """SELECT p.capture_id, p.total_packets, p.ip_packets, p.tcp_udp_packets, p.kept_packets,
 coalesce(f.before_n, 0) AS flows_before_filter, coalesce(f.after_n, 0) AS flows_after_filter
FROM (SELECT capture_id, count(*) AS total_packets, count(*) FILTER (WHERE ip_version = 4) AS ip_packets,
  count(*) FILTER (WHERE ip_version = 4 AND proto IN (6, 17)) AS tcp_udp_packets,
  count(*) FILTER (WHERE {kept}) AS kept_packets FROM packets GROUP BY capture_id) p
LEFT JOIN (SELECT capture_id, count(*) AS before_n, count(*) FILTER (WHERE n >= {k}) AS after_n
 FROM (SELECT capture_id, flow_id, count(*) AS n FROM {source} GROUP BY capture_id, flow_id) x GROUP BY capture_id) f
ON p.capture_id = f.capture_id"""
_FUNNEL_COLUMNS = (
    "total_packets",
    "ip_packets",
    "tcp_udp_packets",
    "kept_packets",
    "flows_before_filter",
    "flows_after_filter",
)


@query(
    "g11_extraction_funnel_stats",
    _FUNNEL.format(kept="ip_version = 4 AND proto IN (6, 17)", k=7, source="client_packets"),
    C,
)
def _(q):
    counted = funnel.flow_funnel(q.packets(), PROCESSOR_STATS, 7)
    return counted.select("capture_id", *big(*_FUNNEL_COLUMNS))


@query(
    "g11_extraction_funnel_directions",
    _FUNNEL.format(
        kept="""ip_version = 4 AND proto IN (6, 17) AND payload_len > 0
   AND NOT (proto = 17 AND (sport = 5353 OR dport = 5353))""",
        k=20,
        source="flow_packets",
    ),
    U,
)
def _(q):
    counted = funnel.flow_funnel(q.packets(), PROCESSOR_DIRECTIONS, 20)
    return counted.select("capture_id", *big(*_FUNNEL_COLUMNS))


@query(
    "r1_bursts",
    """SELECT flow_id, pkt_id AS pkt_no, CAST(sum(fresh) OVER (PARTITION BY flow_id ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst
FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY flow_id ORDER BY ts, pkt_id) >= 1000000 THEN 1 ELSE 0 END AS fresh FROM flow_packets) t""",
    U,
)
def _(q):
    split = bursts.split_at_gaps(q.keyed(), bursts.BURST_GAP)
    return split.select(flow_key_id(), "pkt_no", *big("burst"))


@query(
    "r2_flow_timeout",
    """SELECT flow_id, burst, count(*) AS n_packets, CAST(sum(frame_len) AS BIGINT) AS n_bytes FROM (
 SELECT *, CAST(sum(fresh) OVER (PARTITION BY flow_id ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst
 FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY flow_id ORDER BY ts, pkt_id) >= 60000000 THEN 1 ELSE 0 END AS fresh FROM flow_packets) t) u
GROUP BY flow_id, burst""",
    U,
)
def _(q):
    split = bursts.split_at_gaps(q.keyed(), bursts.FLOW_TIMEOUT)
    return bursts.burst_summary(split).select(flow_key_id(), *big("burst", "n_packets", "n_bytes"))


@query(
    "r2_flow_timeout_one_hour",
    """SELECT flow_id, pkt_id AS pkt_no, CAST(sum(fresh) OVER (PARTITION BY flow_id ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst
FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY flow_id ORDER BY ts, pkt_id) >= 3600000000 THEN 1 ELSE 0 END AS fresh FROM flow_packets) t""",
    U,
)
def _(q):
    split = bursts.split_at_gaps(q.keyed(), 3600.0)
    return split.select(flow_key_id(), "pkt_no", *big("burst"))


