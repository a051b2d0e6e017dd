"""SQL of the derived test tables; the same text runs in Spark SQL and in DuckDB.

Views marked as check-only use global windows or cross products that are fine for
a check on small tables; the Spark side builds those tables with operators.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class View:
    sql: str
    tables: tuple[str, ...] = ()
    views: tuple[str, ...] = ()


VIEWS = {
    "packets": View(
        """
SELECT pkt_id, ts, capture_id,
 CASE WHEN v % 97 = 0 THEN NULL ELSE 4 END AS ip_version, proto,
 CASE WHEN v % 2 = 0 THEN client ELSE server END AS src_ip,
 CASE WHEN v % 2 = 0 THEN server ELSE client END AS dst_ip,
 concat('10.0.0.', CAST(CASE WHEN v % 2 = 0 THEN client ELSE server END AS STRING)) AS src_ip_text,
 concat('10.0.0.', CAST(CASE WHEN v % 2 = 0 THEN server ELSE client END AS STRING)) AS dst_ip_text,
 CASE WHEN v % 2 = 0 THEN cport ELSE sport0 END AS sport,
 CASE WHEN v % 2 = 0 THEN sport0 ELSE cport END AS dport,
 60 + v % 1600 AS frame_len,
 CASE WHEN v % 1600 < 6 THEN 0 ELSE v % 1600 - 6 END AS payload_len
FROM (SELECT event_id AS pkt_id, ts, user_id % 5 AS capture_id, user_id % 30 AS client,
   CASE WHEN event_id % 53 = 0 THEN 251 ELSE 100 + (user_id % 30) % 7 END AS server,
   CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 17 ELSE 6 END AS proto,
   CASE WHEN event_type = 'error' AND event_id % 40 = 1 THEN 5353 ELSE 443 END AS sport0,
   40000 + CASE WHEN user_id % 30 < 10 THEN 0 ELSE event_id % (1 + user_id % 30) END AS cport,
   CAST(floor(value * 100) AS BIGINT) AS v FROM events) e""",
        tables=("events",),
    ),
    # check-only
    "flow_packets": View(
        """
SELECT pkt_id, ts, capture_id, proto, ep_a, port_a, ep_b, port_b, dir, frame_len, payload_len,
 concat_ws(':', CAST(capture_id AS STRING), CAST(proto AS STRING), CAST(ep_a AS STRING), CAST(port_a AS STRING), CAST(ep_b AS STRING), CAST(port_b AS STRING)) AS flow_id,
 row_number() OVER (PARTITION BY capture_id, proto, ep_a, port_a, ep_b, port_b ORDER BY pkt_id) AS pkt_seq
FROM (SELECT pkt_id, ts, capture_id, proto, frame_len, payload_len,
   CASE WHEN fwd THEN src_ip ELSE dst_ip END AS ep_a, CASE WHEN fwd THEN sport ELSE dport END AS port_a,
   CASE WHEN fwd THEN dst_ip ELSE src_ip END AS ep_b, CASE WHEN fwd THEN dport ELSE sport END AS port_b,
   CASE WHEN fwd THEN 1 ELSE -1 END AS dir
  FROM (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND sport <= dport)) AS fwd FROM packets
   WHERE ip_version IS NOT NULL AND proto IN (6, 17) AND payload_len > 0
    AND NOT (proto = 17 AND (sport = 5353 OR dport = 5353))) x) y""",
        views=("packets",),
    ),
    # check-only: text key order, client direction, time order, payload-less packets kept
    "client_packets": View(
        """
SELECT *, CASE WHEN src_ip_text = client THEN 1 ELSE -1 END AS out_sign FROM (
 SELECT *, concat_ws(':', CAST(capture_id AS STRING), CAST(proto AS STRING), ep_a, CAST(port_a AS STRING), ep_b, CAST(port_b AS STRING)) AS flow_id,
  row_number() OVER (PARTITION BY capture_id, proto, ep_a, port_a, ep_b, port_b ORDER BY ts, pkt_id) AS pkt_seq,
  first_value(src_ip_text) OVER (PARTITION BY capture_id, proto, ep_a, port_a, ep_b, port_b ORDER BY ts, pkt_id) AS client
 FROM (SELECT pkt_id, ts, capture_id, proto, frame_len, payload_len, src_ip_text, dst_ip_text, sport, dport,
   CASE WHEN fwd THEN src_ip_text ELSE dst_ip_text END AS ep_a, CASE WHEN fwd THEN sport ELSE dport END AS port_a,
   CASE WHEN fwd THEN dst_ip_text ELSE src_ip_text END AS ep_b, CASE WHEN fwd THEN dport ELSE sport END AS port_b
  FROM (SELECT *, (src_ip_text < dst_ip_text OR (src_ip_text = dst_ip_text AND sport < dport)) AS fwd FROM packets
   WHERE ip_version = 4 AND proto IN (6, 17)) x) y) z""",
        views=("packets",),
    ),
    "captures": View(
        """
SELECT capture_id, concat('/corpus/', CASE WHEN capture_id < 2 THEN 'batch' ELSE 'single' END, '/site', CAST(capture_id % 3 AS STRING), '/pcap/', CAST(capture_id AS STRING), '_x.pcap') AS path,
 capture_id % 3 AS label_id, CAST(sum(frame_len) AS BIGINT) AS length FROM packets GROUP BY capture_id
UNION ALL SELECT 99 AS capture_id, '/corpus/single/site2/pcap/1_empty.pcap' AS path, 2 AS label_id, CAST(24 AS BIGINT) AS length""",
        views=("packets",),
    ),
    # check-only
    "sequences": View(
        """
SELECT f.flow_id, f.pkt_seq, f.dir * CASE WHEN f.frame_len > 1500 THEN 1500 ELSE f.frame_len END AS v
FROM flow_packets f JOIN (SELECT flow_id FROM flow_packets GROUP BY flow_id HAVING count(*) >= 10) k ON f.flow_id = k.flow_id
WHERE f.pkt_seq <= 100""",
        views=("flow_packets",),
    ),
    # check-only
    "packet_hex": View(
        """
SELECT f.flow_id, f.pkt_seq, concat(md5(CAST(f.pkt_id AS STRING)), md5(concat('h', CAST(f.pkt_id AS STRING)))) AS header_hex,
 repeat(md5(concat('p', CAST(f.pkt_id AS STRING))), CAST(1 + f.payload_len % 20 AS INT)) AS payload_hex
FROM flow_packets f JOIN (SELECT flow_id FROM flow_packets GROUP BY flow_id HAVING count(*) >= 5) k ON f.flow_id = k.flow_id
WHERE f.pkt_seq <= 5""",
        views=("flow_packets",),
    ),
    "features": View(
        """
SELECT event_id AS sample_id, event_type AS label, CAST(user_id % 2 AS INT) AS domain,
 CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 89 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS f0,
 value * value AS f1, CAST(user_id AS DOUBLE) AS f2, CAST(event_id % 13 AS DOUBLE) AS f3, CAST(7 AS DOUBLE) AS f4 FROM events""",
        tables=("events",),
    ),
    # f0 decides the label, the other columns tell nothing about it
    "decided": View(
        """
SELECT event_id AS sample_id, event_type AS label, CAST(user_id % 2 AS INT) AS domain,
 CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 10 WHEN 'purchase' THEN 20 WHEN 'signup' THEN 30 ELSE 40 END + event_id % 5 AS DOUBLE) AS f0,
 value AS f1, CAST(user_id AS DOUBLE) AS f2, CAST(event_id % 13 AS DOUBLE) AS f3, CAST(7 AS DOUBLE) AS f4 FROM events""",
        tables=("events",),
    ),
    # ten columns follow the label, three tell nothing
    "graded": View(
        "SELECT event_id AS sample_id, event_type AS label, "
        + ", ".join(
            f"CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 10 WHEN 'purchase' THEN 20 WHEN 'signup' THEN 30 ELSE 40 END + event_id % {5 + k} AS DOUBLE) AS g{k}"
            for k in range(10)
        )
        + ", "
        + ", ".join(f"CAST({k} AS DOUBLE) AS h{k}" for k in range(3))
        + " FROM events",
        tables=("events",),
    ),
    # a thousand classes, some of which are predicted one off
    "many_classes": View(
        "SELECT o_orderkey AS sample_id, CAST(o_custkey % 1000 AS BIGINT) AS label, CAST((o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 1000 AS BIGINT) AS pred FROM orders",
        tables=("orders",),
    ),
    # check-only: a hundred trees, each with two of a thousand classes
    "many_votes": View(
        """
SELECT s_suppkey AS sample_id, tree, (c + k * (1 + tree % 2)) % 1000 AS class_id, CASE WHEN k = 0 THEN p ELSE 1 - p END AS prob
FROM (SELECT s_suppkey, tree, CAST(s_suppkey * 17 + (s_suppkey + tree) % 3 AS BIGINT) AS c, CAST(0.25 AS DOUBLE) + CAST((s_suppkey * 7 + tree * 3) % 50 AS DOUBLE) / 100 AS p
 FROM supplier CROSS JOIN (SELECT n_nationkey * 4 + r_regionkey AS tree FROM nation CROSS JOIN region WHERE r_regionkey < 4) t) v
CROSS JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey < 2) kk""",
        tables=("supplier", "nation", "region"),
    ),
    # check-only
    "samples": View(
        """
SELECT doc_id AS sample_id, concat(lang, '/', source) AS label,
 dense_rank() OVER (ORDER BY concat(lang, '/', source)) - 1 AS label_id, n_chars,
 md5(concat('42:', CAST(doc_id AS STRING))) AS order_key FROM documents""",
        tables=("documents",),
    ),
    "corpus_b": View(
        "SELECT doc_id AS sample_id, CASE WHEN source IN ('src0', 'src1') THEN concat(source, '-b') ELSE source END AS label, CASE WHEN doc_id % 3 = 0 THEN 'homepage' ELSE 'subpage' END AS page_type FROM documents WHERE CAST(floor(doc_id / 20) AS BIGINT) % 2 = 1",
        tables=("documents",),
    ),
    "corpus_a": View(
        "SELECT doc_id AS sample_id, CASE WHEN source = 'src19' THEN 'src19-a' ELSE source END AS label, 'aggregate' AS page_type FROM documents WHERE CAST(floor(doc_id / 20) AS BIGINT) % 2 = 0",
        tables=("documents",),
    ),
    "label_map_b": View(
        "SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM corpus_b) d",
        views=("corpus_b",),
    ),
    "label_map_a": View(
        "SELECT label, row_number() OVER (ORDER BY label DESC) - 1 AS label_id FROM (SELECT DISTINCT label FROM corpus_a) d",
        views=("corpus_a",),
    ),
    "predictions": View(
        """
SELECT vec_id AS sample_id, label, CASE WHEN vec_id % 25 = 3 THEN 10 WHEN vec_id % 4 = 0 THEN (label + 1 + vec_id % 3) % 10 ELSE label END AS pred,
 CAST(50 + vec_id % 50 AS DOUBLE) / 100 AS confidence, CASE WHEN vec_id % 2 = 0 THEN 'val' ELSE 'test' END AS split FROM embeddings""",
        tables=("embeddings",),
    ),
    # check-only
    "votes": View(
        """
SELECT sample_id, tree, (c + k) % 10 AS class_id, CASE WHEN k = 0 THEN p ELSE 1 - p END AS prob
FROM (SELECT vec_id AS sample_id, n_nationkey AS tree, (label + (vec_id + n_nationkey) % 2) % 10 AS c,
   CAST(0.25 AS DOUBLE) + CAST((vec_id * 7 + n_nationkey * 3) % 50 AS DOUBLE) / 100 AS p FROM embeddings CROSS JOIN nation WHERE n_nationkey < 10) t
CROSS JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey < 2) kk""",
        tables=("embeddings", "nation", "region"),
    ),
    "history": View(
        """
SELECT o_orderpriority AS run, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY year(o_orderdate) * 12 + month(o_orderdate)) AS epoch,
 CASE WHEN (year(o_orderdate) * 12 + month(o_orderdate)) % 7 = 3 THEN CAST('NaN' AS DOUBLE) ELSE round(avg(o_totalprice) / 1000000, 6) END AS metric FROM orders GROUP BY o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate)""",
        tables=("orders",),
    ),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for needed in (*_closure(VIEWS[name].views), name):
            if needed not in ordered:
                ordered.append(needed)
    return ordered


def inline(sql: str, views: tuple[str, ...]) -> str:
    """``sql`` with the named views, and those they use, as leading common tables."""
    chain = [f"{name} AS ({VIEWS[name].sql.strip()})" for name in _closure(views)]
    body = sql.strip()
    if not chain:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(chain) + ",\n" + body[5:]
    return "WITH " + ",\n".join(chain) + "\n" + body
