"""Flow operators against brute force, hot keys included."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators import bursts
from flowloom.operators import features as X
from flowloom.operators.flows import FLOW_KEY, first_packets, number_packets
from flowloom.operators.ranking import block_bucket, bounded_buckets, first_rows, hash_bucket, hash_key, hex_digits, ranked
from flowloom.profiles import UNIFIED, UNIFIED_PROPORTIONAL, FlowProfile
from flowloom.streaming.bursts import merge_bursts, open_bursts, stream_bursts

COLUMNS = "capture_id bigint, pkt_no bigint, ts timestamp, proto int, ep_a string, port_a int, ep_b string, port_b int, src_ip_text string, dir int, frame_len int"


def keyed_rows(seed=1, n=600):
    """One flow holds a third of the packets."""
    from datetime import datetime, timedelta, timezone

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        port = 1 if rng.random() < 1 / 3 else rng.randint(2, 30)
        forward = rng.random() < 0.6
        at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=rng.randint(0, 60_000))
        rows.append((7, i, at, 6, "a", port, "b", 443, "a" if forward else "b", 1 if forward else -1, rng.randint(60, 1600)))
    return rows


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame(keyed_rows(), COLUMNS).repartition(5).cache()


def by_flow():
    flows = defaultdict(list)
    for row in keyed_rows():
        flows[row[5]].append(row)
    return flows


@pytest.mark.parametrize("salt", [1, 4])
def test_first_packets_of_a_hot_flow(keyed, salt):
    rows = first_packets(keyed, UNIFIED, 20, salt).select("port_a", "pkt_seq", "pkt_no").collect()
    expected = {
        (port, i + 1, r[1]) for port, flow in by_flow().items() for i, r in enumerate(sorted(flow, key=lambda r: r[1])[:20])
    }
    assert {tuple(r) for r in rows} == expected


@pytest.mark.parametrize("profile", [UNIFIED, FlowProfile("t", time_ordered=True)])
def test_numbering_of_a_hot_flow(keyed, profile):
    rows = number_packets(keyed, profile, rows=16)
    got = {(r.port_a, r.pkt_seq, r.pkt_no) for r in rows.select("port_a", "pkt_seq", "pkt_no").collect()}
    order = (lambda r: (r[2], r[1])) if profile.time_ordered else (lambda r: r[1])
    expected = {
        (port, i + 1, r[1]) for port, flow in by_flow().items() for i, r in enumerate(sorted(flow, key=order))
    }
    assert got == expected


def test_client_direction_follows_the_first_sender(keyed):
    profile = FlowProfile("t", direction="client", outgoing=-1, time_ordered=True)
    rows = first_packets(keyed.drop("dir"), profile, 1000).select("port_a", "pkt_no", "dir").collect()
    got = {(r.port_a, r.pkt_no): r.dir for r in rows}
    for port, flow in by_flow().items():
        client = min(flow, key=lambda r: (r[2], r[1]))[8]
        for r in flow:
            assert got[(port, r[1])] == (-1 if r[8] == client else 1)


def test_global_rank_is_exact(spark):
    ids = spark.range(5000).withColumn("key", hash_key(42, "id"))
    rows = ranked(ids, [], ["key", "id"], hash_bucket("key"), "rank", "n").collect()
    ordered = [r.id for r in sorted(rows, key=lambda r: (r.key, r.id))]
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == ordered
    assert {r.n for r in rows} == {5000}


def test_rank_spreads_a_hot_group(spark):
    rows = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    plan = ranked(rows, ["g"], ["id"], block_bucket("id", 100), "r")
    got = {(r.g, r.r): r.id for r in plan.collect()}
    groups = defaultdict(list)
    for i in range(3000):
        groups[0 if i % 3 == 0 else i % 50].append(i)
    assert got == {(g, i + 1): v for g, ids in groups.items() for i, v in enumerate(ids)}
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # numbered inside (group, bucket), which are structs so that null groups count too
    window = text.split("row_number() windowspecdefinition(")[1]
    assert window.startswith("_group") and "_slice" in window.split("ASC")[0]


def test_limit_is_applied_before_the_shuffle(spark):
    rows = spark.range(100_000).withColumn("g", F.col("id") % 3)
    text = first_rows(rows, ["g"], ["id"], 5000, salt=1)._jdf.queryExecution().executedPlan().toString()
    final, rest = text.split("Exchange", 1)
    assert "Final" in final and "Partial" in rest


def numpy_block(values, kurtosis_min_n=4):
    if len(values) == 0:
        return [0.0] * 18
    x = np.array(values, dtype=float)
    centred = x - x.mean()
    m2 = (centred**2).mean()
    skew = (centred**3).mean() / m2**1.5 if len(x) >= 3 and m2 > 0 else 0.0
    kurt = (centred**4).mean() / m2**2 - 3 if len(x) >= kurtosis_min_n and m2 > 0 else 0.0
    mad = np.median(np.abs(x - np.median(x)))
    return [len(x), x.min(), x.max(), x.mean(), x.std(), x.var(), skew, kurt, mad] + [
        np.percentile(x, p) for p in X.DECILES
    ]


def check_vectors(rows, cut):
    assert len(rows) == len(cut)
    for row in rows:
        packets = cut[row.port_a]
        lengths = {
            "in": [p[10] for p in packets if p[9] == -1],
            "out": [p[10] for p in packets if p[9] == 1],
            "bi": [p[10] for p in packets],
        }
        expected = [v for d in X.DIRECTIONS for v in numpy_block(lengths[d])]
        np.testing.assert_allclose([row[c] for c in X.FEATURE_NAMES], expected, rtol=1e-9, atol=1e-7)


def test_statistics_match_numpy(keyed):
    rows = X.flow_statistics(keyed, UNIFIED, max_packets=40).collect()
    cut = {p: sorted(f, key=lambda r: r[1])[:40] for p, f in by_flow().items() if len(f) >= 7}
    check_vectors(rows, cut)


def test_proportional_statistics_match_numpy(keyed):
    rows = X.flow_statistics(keyed, UNIFIED_PROPORTIONAL, max_packets=40).collect()
    cut = {}
    for port, flow in by_flow().items():
        if len(flow) < 7:
            continue
        flow = sorted(flow, key=lambda r: r[1])
        out, incoming = [r for r in flow if r[9] == 1], [r for r in flow if r[9] == -1]
        if len(flow) > 40:
            quota = int(40 * (len(out) / len(flow)))
            out, incoming = out[:quota], incoming[: 40 - quota]
        cut[port] = out + incoming
    check_vectors(rows, cut)


def test_small_and_constant_samples(spark):
    base = keyed_rows(n=1)[0]
    lengths = {1: [5], 2: [5, 9], 3: [5, 9, 30], 4: [7, 7, 7, 7], 5: [1, 2, 4, 9, 30]}
    rows = [
        (*base[:1], port * 100 + i, *base[2:5], port, *base[6:9], 1, v)
        for port, values in lengths.items()
        for i, v in enumerate(values)
    ]
    frame = spark.createDataFrame(rows, COLUMNS)
    got = {r.port_a: r for r in X.flow_statistics(frame, UNIFIED, min_packets=1).collect()}
    for port, values in lengths.items():
        expected = numpy_block(values)
        np.testing.assert_allclose([got[port][f"out_{s}"] for s in X.BLOCK_STATS], expected, atol=1e-9)
        assert all(got[port][f"in_{s}"] == 0.0 for s in X.BLOCK_STATS)
    assert round(got[5].out_skew, 5) == 1.27399 and round(got[5].out_kurt, 5) == -0.08789
    three = X.flow_statistics(frame, FlowProfile("p", kurtosis_min_n=3), min_packets=1)
    assert {r.port_a: r for r in three.collect()}[3].out_kurt == pytest.approx(-1.5)


@pytest.mark.parametrize("profile", [UNIFIED, UNIFIED_PROPORTIONAL, FlowProfile("c", direction="client", time_ordered=True, kurtosis_min_n=3)])
def test_counted_statistics_equal_listed_ones(spark, keyed, profile):
    rows = keyed.drop("dir") if profile.direction == "client" else keyed
    rows = rows.withColumn("frame_len", F.when(F.col("pkt_no") % 11 > 0, F.when(F.col("port_a") == 5, 700).otherwise(F.col("frame_len"))))
    listed = {r.port_a: r for r in X.flow_statistics(rows, profile, max_packets=5000).collect()}
    for most in (5001, *([None] if profile.direction == "canonical" else [])):
        counted = X.flow_statistics(rows, profile, max_packets=most).collect()
        assert {r.port_a for r in counted} == set(listed) and len(counted) == len(listed)
        for r in counted:
            for c in X.FEATURE_NAMES:
                assert r[c] == pytest.approx(listed[r.port_a][c], rel=1e-9, abs=1e-7), c


def test_statistics_of_a_long_flow_have_no_large_task(spark, dense, many_partitions):
    """A third of all packets in one flow: what is shuffled is its lengths, not its packets."""
    got = {}
    wanted = X.flow_statistics(dense, UNIFIED, max_packets=None).select("port_a", "bi_count", "bi_p50", "bi_mad")
    most = largest_shuffle_read(spark, lambda: got.update({r.port_a: tuple(r)[1:] for r in wanted.collect()}))
    lengths = defaultdict(list)
    for r in dense.select("port_a", "frame_len").collect():
        lengths[r.port_a].append(r.frame_len)
    values = np.array(lengths[1])
    assert got[1] == (len(values), np.median(values), np.median(np.abs(values - np.median(values))))
    assert most < 5000 < len(values)


def brute_bursts(flow, gap, strict=False):
    ids, burst, last = {}, 0, None
    for r in sorted(flow, key=lambda r: (r[2], r[1])):
        silent = None if last is None else (r[2] - last).total_seconds()
        if silent is not None and (silent > gap if strict else silent >= gap):
            burst += 1
        ids[r[1]] = burst
        last = r[2]
    return ids


@pytest.mark.parametrize("gap,rows", [(1.0, 10**6), (0.25, 5), (3.0, 1), (3600.0, 7)])
def test_bursts_match_brute_force(keyed, gap, rows):
    rows = bursts.split_at_gaps(keyed, gap, rows=rows).select("pkt_no", "burst").collect()
    expected = {}
    for flow in by_flow().values():
        expected.update(brute_bursts(flow, gap))
    assert {r.pkt_no: r.burst for r in rows} == expected


def boundary_rows():
    from datetime import datetime, timedelta, timezone

    base = keyed_rows(n=1)[0]
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    # gaps of 0.9 s, exactly 1.0 s, 1.1 s; a late packet of another flow moves the watermark on
    times = [0.0, 0.9, 1.9, 3.0]
    rows = [(*base[:1], i, start + timedelta(seconds=t), *base[3:]) for i, t in enumerate(times)]
    rows.append((*base[:1], 99, start + timedelta(seconds=100), *base[3:5], 31, *base[6:]))
    return rows


def test_exact_gap_boundary_in_batch(spark):
    rows = bursts.split_at_gaps(spark.createDataFrame(boundary_rows(), COLUMNS), 1.0)
    assert {r.pkt_no: r.burst for r in rows.collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 99: 0}


BURST = [*FLOW_KEY, "n_packets", "n_bytes", "first_ts", "last_ts"]


def drained(stream, gap, sink, checkpoint, late="0 seconds"):
    out = stream_bursts(stream, gap, late)
    job = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    job.awaitTermination()
    return out.schema, job


def batch_bursts(table, gap):
    return sorted(map(tuple, bursts.burst_summary(bursts.split_at_gaps(table, gap)).select(*BURST).collect()), key=repr)


def test_exact_gap_boundary_in_a_stream(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "c"))
    table = spark.createDataFrame(boundary_rows(), COLUMNS)
    table.coalesce(1).write.parquet(source)
    schema, _ = drained(spark.readStream.schema(table.schema).parquet(source), 1.0, sink, state)
    closed = spark.read.schema(schema).parquet(sink)
    assert sorted(r.n_packets for r in closed.filter("port_a <> 31").collect()) == [1, 1, 2]
    # the late packet's own burst is still open
    assert [r.port_a for r in open_bursts(spark, state).collect()] == [31]


@pytest.mark.parametrize("gap,late", [(1.0, "0 seconds"), (60.0, "10 seconds"), (3600.0, "0 seconds")])
def test_stream_and_its_state_equal_batch_over_restarts(spark, keyed, tmp_path, gap, late):
    """Three runs from one checkpoint, each over files that are new; rows of a file come in any order."""
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "c"))
    order = F.unix_micros("ts")
    cuts = [20_000_000, 40_000_000, 10**9]
    start = keyed.agg(F.min(order)).first()[0]
    low, counts = 0, []
    for high in cuts:
        part = keyed.filter((order - start >= low) & (order - start < high))
        part.repartition(1).orderBy(F.xxhash64("pkt_no")).write.mode("append").parquet(source)
        schema, job = drained(spark.readStream.schema(keyed.schema).parquet(source), gap, sink, state, late)
        low = high
        found = spark.read.schema(schema).parquet(sink).unionByName(open_bursts(spark, state))
        so_far = spark.read.schema(keyed.schema).parquet(source)
        assert sorted(map(tuple, found.select(*BURST).collect()), key=repr) == batch_bursts(so_far, gap)
        counts.append(spark.read.schema(schema).parquet(sink).count())
    assert (counts[-1] > 0) == (gap == 1.0)


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "c"))
    rows = boundary_rows()
    schema = spark.createDataFrame(rows, COLUMNS).schema
    dropped = 0
    for part in (rows[2:], rows[:1]):  # the first packet comes after one of 100 seconds later
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        out, job = drained(spark.readStream.schema(schema).parquet(source), 1.0, sink, state, "5 seconds")
        dropped += sum(op["numRowsDroppedByWatermark"] for p in job.recentProgress for op in p["stateOperators"])
    found = spark.read.schema(out).parquet(sink).unionByName(open_bursts(spark, state))
    assert dropped == 1 and sorted(r.n_packets for r in found.collect()) == [1, 1, 1]


def test_bursts_merge_whatever_the_order_of_their_rows():
    rng = np.random.default_rng(3)
    for _ in range(50):
        times = rng.integers(0, 200, 30)
        parts = np.column_stack((times, times, np.ones(30, np.int64), np.full(30, 5)))
        whole = merge_bursts(parts, 7)
        halves = merge_bursts(np.concatenate((merge_bursts(parts[:11], 7), merge_bursts(parts[11:], 7))), 7)
        assert (whole == halves).all() and whole[:, 2].sum() == 30
        assert (whole[1:, 0] - whole[:-1, 1] >= 7).all()


# --- bounded tasks ---


def largest_shuffle_read(spark, run):
    """Most rows any task has read from a shuffle while ``run`` was working."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    before = {s.stageId() for s in stages(store, gateway)}
    run()
    most = 0
    for stage in stages(store, gateway):
        if stage.stageId() not in before:
            tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                if metrics.isDefined():
                    most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return most


def stages(store, gateway):
    none = gateway.jvm.java.util.ArrayList()
    found = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return [found.apply(i) for i in range(found.size())]


@pytest.fixture
def many_partitions(spark):
    """Enough partitions that one too large stands out, none of them joined or split at run time."""
    wanted = {"spark.sql.shuffle.partitions": "101", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def dense(spark):
    """20,000 packets; one flow has a third of them, all within 50 milliseconds, many at the same time."""
    i = F.col("id")
    hot = i % 3 == 0
    at = F.lit(1_700_000_000_000_000) + F.when(hot, (i * 7919) % 50_000 - (i * 7919) % 250).otherwise(i * 131_071 % 600_000_000)
    columns = [
        F.lit(7).cast("long").alias("capture_id"), i.alias("pkt_no"), F.timestamp_micros(at).alias("ts"), F.lit(6).alias("proto"),
        F.lit("a").alias("ep_a"), F.when(hot, 1).otherwise(2 + i % 400).cast("int").alias("port_a"), F.lit("b").alias("ep_b"),
        F.lit(443).alias("port_b"), F.lit("a").alias("src_ip_text"), F.lit(1).alias("dir"), (60 + i % 1000).cast("int").alias("frame_len"),
    ]
    return spark.range(20_000).select(*columns).cache()


def dense_flows(dense):
    flows = defaultdict(list)
    for r in dense.select("port_a", "ts", "pkt_no").collect():
        flows[r.port_a].append((r.ts, r.pkt_no))
    return {port: sorted(rows) for port, rows in flows.items()}


@pytest.mark.parametrize("gap", [1.0, 60.0, 3600.0])
def test_gaps_of_a_dense_flow_in_small_tasks(spark, dense, many_partitions, gap):
    expected = {}
    for rows in dense_flows(dense).values():
        burst, last = 0, None
        for at, number in rows:
            burst += last is not None and (at - last).total_seconds() >= gap
            expected[number], last = burst, at
    got = {}
    split = bursts.split_at_gaps(dense, gap, rows=100).select("pkt_no", "burst")
    most = largest_shuffle_read(spark, lambda: got.update({r.pkt_no: r.burst for r in split.collect()}))
    assert got == expected
    assert most <= 1000 < 20_000 / 3


def test_time_order_of_a_dense_flow_in_small_tasks(spark, dense, many_partitions):
    expected = {n: i + 1 for rows in dense_flows(dense).values() for i, (_, n) in enumerate(rows)}
    got = {}
    numbered = number_packets(dense, FlowProfile("t", time_ordered=True), rows=100).select("pkt_no", "pkt_seq")
    most = largest_shuffle_read(spark, lambda: got.update({r.pkt_no: r.pkt_seq for r in numbered.collect()}))
    assert got == expected
    assert most <= 1000 < 20_000 / 3


def test_buckets_are_bounded_and_in_order(spark):
    keys = spark.range(6000).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 4))
    keys = keys.withColumn("key", F.concat(F.lit("0"), F.substring(F.md5(F.col("id").cast("string")), 1, 11)))
    cut = bounded_buckets(keys, ["g"], hex_digits("key"), 20)
    rows = cut.select("id", "g", "key", F.col("_radix").cast("string").alias("b"), F.dense_rank().over(W.partitionBy("g").orderBy("_radix")).alias("n")).collect()
    assert sorted(r.id for r in rows) == list(range(6000))
    groups = defaultdict(list)
    for r in rows:
        groups[r.g].append((r.key, r.n))
    for members in groups.values():
        places = [n for _, n in sorted(members)]
        assert places == sorted(places) and max(places.count(n) for n in set(places)) <= 20
