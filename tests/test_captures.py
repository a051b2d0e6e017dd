"""Capture listing, decoding and ingest on files written here."""

from __future__ import annotations

import io
import ipaddress
import json
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.catalog import registry, source_queries
from flowloom.operators.features import flow_images, length_sequences
from flowloom.operators.flows import FLOW_KEY, flow_id, flow_packets
from flowloom.plans.corpus_features import corpus_features
from flowloom.profiles import PROCESSOR_STATS, UNIFIED, FlowProfile
from flowloom.sources import captures as C
from flowloom.sources import decode as D
from flowloom.streaming import growing as G
from flowloom.streaming.ingest import ingest
from tests import capture_files as W

A, B = "10.0.0.9", "10.0.0.102"
A6, B6 = "2001:db8::1", "2001:db8:0:0:5::2"


def talk(n, payload=b"x" * 30, link=W.ETHERNET):
    """n TCP packets back and forth."""
    frames = []
    for i in range(n):
        ends = (A, B, 40000, 443) if i % 3 != 1 else (B, A, 443, 40000)
        src, dst, sport, dport = ends
        frames.append(W.link_frame(link, W.ipv4(src, dst, 6, W.tcp(sport, dport, payload + bytes([i % 256])))))
    return frames


def packets_of(spark, content, **kw):
    rows = spark.createDataFrame([(1, bytearray(content))], "capture_id bigint, content binary")
    return D.decode_frames(D.frames_from_content(rows), **kw).orderBy("pkt_no").collect()


def test_link_types_byte_orders_and_resolutions(spark):
    cases = [
        (link, writer, endian, nano)
        for link in (W.ETHERNET, W.RAW, W.SLL, W.SLL2, W.NULL)
        for writer in (W.pcap, W.pcapng)
        for endian in "<>"
        for nano in (False, True)
    ]
    rows, sizes = [], {}
    for i, (link, writer, endian, nano) in enumerate(cases):
        frames = [
            W.link_frame(link, W.ipv4(A, B, 6, W.tcp(40000, 443, b"hello", options=b"\x01" * 12))),
            W.link_frame(link, W.ipv6(A6, B6, 17, W.udp(53, 5353, b"dns"))),
        ]
        sizes[i] = len(frames[0])
        rows.append((i, bytearray(writer(frames, link, endian, nano=nano))))
    contents = spark.createDataFrame(rows, "capture_id bigint, content binary")
    decoded = D.decode_frames(D.frames_from_content(contents)).orderBy("capture_id", "pkt_no").collect()
    assert len(decoded) == 2 * len(cases)
    for first, second in zip(decoded[::2], decoded[1::2]):
        assert (first.ip_version, first.src_ip_text, first.dst_ip_text) == (4, A, B)
        assert (first.sport, first.dport, first.proto, first.payload_len) == (40000, 443, 6, 5)
        assert bytes(first.payload) == b"hello"
        assert len(first.ip_header) == 20 and len(first.l4_header) == 20
        assert first.frame_len == sizes[first.capture_id]
        assert first.ts.timestamp() == 1000.0 and second.ts.timestamp() == 1000.25
        assert (second.ip_version, second.proto, second.payload_len) == (6, 17, 3)
        assert second.src_ip_text == ipaddress.ip_address(A6).compressed
        assert second.dst_ip_text == ipaddress.ip_address(B6).compressed
        assert bytes(second.src_ip) == ipaddress.ip_address(A6).packed
        assert bytes(first.src_ip) == b"\x00" * 12 + ipaddress.ip_address(A).packed


def test_ipv6_text_is_compressed(spark):
    texts = ["::", "::1", "1::", "1:0:0:2::3", "1:2:3:4:5:6:7:8", "fe80::1:0:0:2", "0:0:1::", "1:0:2:0:3:0:4:0"]
    frames = [W.link_frame(W.RAW, W.ipv6(t, "::2", 17, W.udp(1, 2, b"p"))) for t in texts]
    rows = packets_of(spark, W.pcap(frames, W.RAW))
    assert [r.src_ip_text for r in rows] == [ipaddress.ip_address(t).compressed for t in texts]


def test_unusual_packets(spark):
    whole = W.ipv4(A, B, 6, W.tcp(1, 2, b"abc"))
    frames = [
        W.vlan_frame(whole),
        W.link_frame(W.ETHERNET, b"\x00" * 28, ethertype=0x0806),
        W.link_frame(W.ETHERNET, W.ipv4(A, B, 1, b"\x08\x00ping")),
        W.link_frame(W.ETHERNET, W.ipv4(A, B, 6, b"later fragment" * 3, fragment=100)),
        W.link_frame(W.ETHERNET, W.ipv4(A, B, 6, b"short")),
        W.link_frame(W.ETHERNET, whole + b"\x00" * 6),
        W.link_frame(W.ETHERNET, W.ipv4(A, B, 17, W.udp(9, 10, b"q"), options=b"\x01" * 4)),
        W.link_frame(W.ETHERNET, W.ipv4(A, B, 6, W.tcp(1, 2, b"offload"), total=0)),
        W.link_frame(W.ETHERNET, b"\x45\x00"),
    ]
    rows = packets_of(spark, W.pcap(frames))
    assert [r.ip_version for r in rows] == [4, None, 4, 4, 4, 4, 4, 4, None]
    assert [r.proto for r in rows] == [6, None, 1, None, None, 6, 17, 6, None]
    assert [r.payload_len for r in rows] == [3, 0, 0, 0, 0, 3, 1, 7, 0]
    assert rows[1].src_ip_text is None and rows[1].src_ip is None


def test_tag_stacks_and_extension_headers(spark):
    udp = W.udp(9, 10, b"data")
    inner = W.ipv4(A, B, 17, udp)
    mac = b"\x02" * 12
    labels = b"\x00\x01\x00\x40" + b"\x00\x02\x01\x40"  # the second is the bottom of the stack
    hop = lambda nxt: bytes([nxt, 0]) + b"\x00" * 6
    auth = lambda nxt: bytes([nxt, 4]) + b"\x00" * 22
    part = lambda nxt, offset: bytes([nxt, 0]) + (offset << 3).to_bytes(2, "big") + b"\x00" * 4
    frames = [
        mac + b"\x81\x00\x00\x05" * 5 + b"\x08\x00" + inner,
        mac + b"\x88\x47" + labels + inner,
        mac + b"\x81\x00\x00\x05" + b"\x88\x48" + labels + W.ipv6(A6, B6, 17, udp),
        W.link_frame(W.ETHERNET, W.ipv6(A6, B6, 0, hop(60) + hop(51) + auth(17) + udp)),
        W.link_frame(W.ETHERNET, W.ipv6(A6, B6, 44, part(17, 0) + udp)),
        W.link_frame(W.ETHERNET, W.ipv6(A6, B6, 44, part(17, 100) + udp)),
        W.link_frame(W.ETHERNET, W.ipv6(A6, B6, 0, b"\x11")),
        mac + b"\x81\x00\x00\x05" * 3,
    ]
    rows = packets_of(spark, W.pcap(frames))
    assert [r.ip_version for r in rows] == [4, 4, 6, 6, 6, 6, 6, None]
    assert [r.sport for r in rows] == [9, 9, 9, 9, 9, None, None, None]
    assert [r.payload_len for r in rows] == [4, 4, 4, 4, 4, 0, 0, 0]


def test_errors_stay_with_the_packets(spark, tmp_path):
    good = tmp_path / "good.pcap"
    good.write_bytes(W.pcap(talk(4)))
    foreign = tmp_path / "foreign.pcap"
    foreign.write_bytes(b"not a capture")
    rows = [(1, str(good), None), (2, str(foreign), 13), (3, str(tmp_path / "absent.pcap"), 10)]
    captures = spark.createDataFrame(rows, "capture_id bigint, path string, length bigint")
    for large in (1 << 40, 1):  # whole files, and byte ranges
        packets = D.read_packets(captures, with_bytes=False, large_bytes=large)
        assert packets.filter("frame_len IS NOT NULL").groupBy("capture_id").count().collect() == [(1, 4)]
        assert {r.capture_id for r in D.capture_errors(packets).collect()} == {2, 3}


def test_payload_is_cut_in_the_reader(spark, tmp_path):
    path = tmp_path / "a.pcap"
    path.write_bytes(W.pcap([W.link_frame(W.ETHERNET, W.ipv4(A, B, 6, W.tcp(1, 2, b"x" * 1000)))]))
    captures = spark.createDataFrame([(1, str(path), 1100)], "capture_id bigint, path string, length bigint")
    (row,) = D.read_packets(captures, payload_bytes=240).collect()
    assert len(row.payload) == 240 and row.payload_len == 1000


def test_flow_ids_of_decoded_packets_are_text(spark):
    packets = spark.createDataFrame([(1, bytearray(W.pcap(talk(4))))], "capture_id bigint, content binary")
    keyed = flow_packets(D.packets_from_content(packets), UNIFIED)
    ids = [r[0] for r in keyed.select(flow_id()).distinct().collect()]
    assert ids and all(i.isascii() and i.isprintable() for i in ids)


def test_probe_ignores_the_declared_link_type(spark):
    mixed = [W.link_frame(k, W.ipv4(A, B, 6, W.tcp(1, 2, b"abc"))) for k in (W.ETHERNET, W.SLL, W.RAW)]
    rows = packets_of(spark, W.pcap(mixed, link=W.NULL), link="probe")
    assert [(r.ip_version, r.sport, r.payload_len) for r in rows] == [(4, 1, 3)] * 3
    declared = packets_of(spark, W.pcap(mixed, link=W.ETHERNET))
    assert [r.ip_version for r in declared] == [4, None, None]


def test_broken_files_give_errors_not_failures(spark):
    good = W.pcap(talk(4))
    rows = spark.createDataFrame(
        [(1, bytearray(good[:-10])), (2, bytearray(b"not a capture")), (3, bytearray(good + b"\x01\x02")), (4, bytearray(b""))],
        "capture_id bigint, content binary",
    )
    frames = D.frames_from_content(rows)
    kept = {r.capture_id: r.n for r in frames.filter("frame is not null").groupBy("capture_id").agg(F.count("*").alias("n")).collect()}
    assert kept == {1: 4, 3: 4}
    errors = {r.capture_id: r.error for r in D.capture_errors(frames).collect()}
    assert errors[1] == "truncated frame"
    assert errors[2] == "not a capture file" and errors[4] == "not a capture file"
    assert errors[3] == "truncated record header"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for label, name, content in [
        ("chat", "a.pcap", W.pcap(talk(40))),
        ("chat", "deep/b.PCAPNG", W.pcapng(talk(30))),
        ("mail", "c.pcap", W.pcap(talk(60), endian=">")),
        ("mail", "tiny.pcap", W.pcap(talk(1))),
        ("mail", "notes.txt", b"no capture"),
    ]:
        path = root / label / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return root


def test_captures_from_dirs(spark, tree):
    rows = C.captures_from_dirs(spark, str(tree)).collect()
    assert sorted((r.label, r.path.rsplit("/", 1)[1]) for r in rows) == [
        ("chat", "a.pcap"),
        ("chat", "b.PCAPNG"),
        ("mail", "c.pcap"),
        ("mail", "tiny.pcap"),
    ]
    big = C.captures_from_dirs(spark, str(tree), min_bytes=1000)
    assert big.filter("path like '%tiny%'").count() == 0
    plan = big._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(length,1000)" in plan
    assert "content" not in plan


def test_ablation_tree(spark, tmp_path):
    for name in ["batch/siteB/pcap/x.pcap", "single/siteA/pcap/1_home.pcap", "single/siteA/pcap/2_sub.pcap", "single/siteA/other/1_x.pcap"]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(W.pcap(talk(2)))
    rows = C.ablation_captures(spark, str(tmp_path)).collect()
    assert sorted((r.label, r.label_id, r.page_type) for r in rows) == [
        ("siteA", 0, "homepage"),
        ("siteA", 0, "subpage"),
        ("siteB", 1, "aggregate"),
    ]


def test_tree_listed_by_tasks(spark, tmp_path):
    """Level by level, the same files as the file source lists, hidden names left out."""
    for i in range(300):
        folder = tmp_path / f"site {i % 9}" / f"day={i % 4}" / ("deep/er" if i % 50 == 0 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.{'pcap' if i % 3 else 'txt'}").write_bytes(b"x" * (i + 1))
    for hidden in ("_temporary/1.pcap", ".git/2.pcap", "site 1/_3.pcap", "empty folder/.4.pcap"):
        (tmp_path / hidden).parent.mkdir(exist_ok=True)
        (tmp_path / hidden).write_bytes(b"y")
    for glob in (None, "*.pcap", "1?.*"):
        listed = sorted(map(tuple, C.list_tree(spark, str(tmp_path), glob).collect()))
        assert listed == sorted(map(tuple, C.list_files(spark, str(tmp_path), glob).collect())) and listed
    by_tasks = C.captures_from_dirs(spark, str(tmp_path), 10, C.list_tree)
    assert sorted(map(tuple, by_tasks.collect())) == sorted(map(tuple, C.captures_from_dirs(spark, str(tmp_path), 10).collect()))


def test_sample_tree(spark, tmp_path):
    for name in ["train/b/1.json", "train/a/2.pcap", "val/b/3.png", "val/b/ignored.txt"]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("{}")
    rows = C.sample_tree(spark, str(tmp_path)).collect()
    assert sorted((r.split, r.label, r.label_id) for r in rows) == [("train", "a", 0), ("train", "b", 1), ("val", "b", 1)]


def test_label_files(spark, tmp_path):
    (tmp_path / "map.csv").write_text("path,label\n/x/1.pcap,3\n/x/2.pcap,0\n")
    (tmp_path / "vocab.csv").write_text("service_id,service\n0,chat\n3,mail\n")
    rows = C.captures_from_csv(spark, str(tmp_path / "map.csv")).join(
        C.vocab_from_csv(spark, str(tmp_path / "vocab.csv")), "label_id"
    )
    assert sorted((r.path, r.label) for r in rows.collect()) == [("/x/1.pcap", "mail"), ("/x/2.pcap", "chat")]


def lookalikes(n):
    """Packets whose payload looks like capture records, to mislead a guess."""
    inner = W.pcap([b"a" * 20] * 40)[24:]
    return talk(n, payload=inner)


def test_chunks_of_a_large_capture_equal_the_whole(spark, tmp_path):
    contents = {
        "a.pcap": W.pcap(talk(200)),
        "b.pcapng": W.pcapng(talk(150)),
        "big_endian.pcap": W.pcap(talk(180), endian=">", nano=True),
        "lookalike.pcap": W.pcap(lookalikes(30)),
        "cut.pcap": W.pcap(talk(100))[:-7],
        "cut_header.pcap": W.pcap(talk(100)) + b"\x01" * 5,
        "long_record.pcap": W.pcap([*talk(20), b"z" * 9000, *talk(20)]),
        "broken.pcap": b"nothing" * 1000,
        "empty.pcap": b"",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    files = C.list_files(spark, str(tmp_path)).withColumn("capture_id", C.capture_id(F.col("path")))
    key = ["capture_id", "pkt_no", "ts_us", "datalink", "frame_len", "frame", "error"]
    whole = sorted(map(tuple, D.frames_from_paths(files).select(*key).collect()), key=repr)
    for build in (D.capture_chunks, D.sequential_chunks):
        chunks = build(files, chunk_bytes=3000)
        assert chunks.filter("state is not null").count() > 20
        pieces = sorted(map(tuple, D.frames_from_chunks(chunks).select(*key).collect()), key=repr)
        assert pieces == whole
    assert len([r for r in whole if r[5] is not None]) == 200 + 150 + 180 + 30 + 100 + 100 + 41


def test_parallel_ranges_cover_regular_captures(spark, tmp_path):
    """Guessed starts are right for ordinary traffic, so nothing is left to a single task."""
    (tmp_path / "a.pcap").write_bytes(W.pcap(talk(400, payload=b"data" * 40), start=1_700_000_000))
    files = C.list_files(spark, str(tmp_path)).withColumn("capture_id", C.capture_id(F.col("path")))
    ranges = D.walk_ranges(files, 4000).orderBy("low").collect()
    assert len(ranges) > 20
    assert all(a.stop == b.start for a, b in zip(ranges, ranges[1:]))
    assert sum(r.n for r in ranges) == 400


def test_headers_deep_in_a_frame(spark, tmp_path):
    """Chains of tags and extension headers over 256 bytes, in every way of reading."""
    body = W.udp(40000, 443, b"q" * 400)
    tags = b"\x81\x00\x00\x05" * 70
    long_options = struct.pack(">BB", 17, 37) + b"\x00" * 302  # one options header of 304 bytes
    six = bytearray(W.ipv6(A6, B6, 0, long_options + body))
    frames = [b"\x02" * 12 + tags + b"\x08\x00" + W.ipv4(A, B, 17, body), W.link_frame(W.ETHERNET, bytes(six))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(W.pcap(frames * 20, start=1_700_000_000))
    files = C.list_files(spark, str(tmp_path / "in")).withColumn("capture_id", C.capture_id(F.col("path")))
    G.ingest_growing(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), with_bytes=False).awaitTermination()
    ways = [
        D.read_packets(files),
        D.read_packets(files, with_bytes=False),
        D.read_packets(files, payload_bytes=240),
        D.read_packets(files, with_bytes=False, large_bytes=1000),
        D.packets_from_paths(files, with_bytes=False),
        D.packets_from_chunks(D.capture_chunks(files, 3000), with_bytes=False),
        spark.read.parquet(str(tmp_path / "out")),
    ]
    for packets in ways:
        rows = packets.select("proto", "sport", "payload_len").collect()
        assert len(rows) == 40 and {tuple(r) for r in rows} == {(17, 40000, 400)}
    kept = {bytes(r.payload) for r in D.read_packets(files, payload_bytes=240).select("payload").collect()}
    assert kept == {b"q" * 240}


def test_packets_are_the_same_without_bytes(spark, tree):
    captures = C.captures_from_dirs(spark, str(tree))
    slim = D.read_packets(captures, with_bytes=False)
    full = D.read_packets(captures).select(slim.columns)
    assert sorted(map(tuple, slim.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)


def test_large_and_small_files_read_alike(spark, tree):
    captures = C.captures_from_dirs(spark, str(tree))
    a = D.read_frames(captures).select("capture_id", "pkt_no", "frame")
    b = D.read_frames(captures, large_bytes=2000).select("capture_id", "pkt_no", "frame")
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_incremental_ingest_equals_batch(spark, tmp_path):
    root, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    root.mkdir()
    (root / "a.pcap").write_bytes(W.pcap(talk(20)))
    ingest(spark, str(root), str(out), str(checkpoint)).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 20
    (root / "b.pcap").write_bytes(W.pcap(talk(30)))
    ingest(spark, str(root), str(out), str(checkpoint)).awaitTermination()
    stream = spark.read.parquet(str(out))
    batch = D.decode_frames(D.frames_from_content(D.captures_with_content(spark, str(root))))
    assert stream.count() == 50
    stream = stream.select(batch.columns)
    assert sorted(map(tuple, stream.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_a_streamed_capture_is_read_in_ranges_and_a_repeated_batch_replaces(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    (root / "a.pcap").write_bytes(W.pcap(talk(300, payload=b"data" * 40), start=1_700_000_000))
    for run in range(2):  # without its checkpoint the same batch is written again
        ingest(spark, str(root), str(out), str(tmp_path / f"check{run}"), large_bytes=5000).awaitTermination()
    packets = spark.read.parquet(str(out))
    whole = D.read_packets(C.list_files(spark, str(root)).withColumn("capture_id", C.capture_id(F.col("path"))))
    assert sorted(map(tuple, packets.select(whole.columns).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


@pytest.mark.parametrize("with_bytes", [True, False])
def test_growing_captures_resume_inside_files(spark, tmp_path, with_bytes):
    """Files cut anywhere, also inside a record header, and completed between the runs."""
    root, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    (root / "deep").mkdir(parents=True)
    whole = {
        "a.pcap": W.pcap(talk(300, payload=b"data" * 40), start=1_700_000_000),
        "deep/b.pcap": W.pcap(talk(180), endian=">", nano=True, start=1_700_000_000),
        "c.pcapng": W.pcapng(talk(150), start=1_700_000_000),
        "d.pcap": W.pcap(lookalikes(30)),
        "other.txt": b"no capture",
    }
    for share in (0.0005, 0.31, 0.313, 0.9, 1.0, 1.0):
        for name, content in whole.items():
            (root / name).write_bytes(content[: int(len(content) * share)])
        G.ingest_growing(spark, str(root), str(out), str(checkpoint), with_bytes=with_bytes, chunk_bytes=2500).awaitTermination()
    got = spark.read.parquet(str(out))
    assert got.filter("error is not null").count() == 0
    batch = D.decode_frames(D.frames_from_content(D.captures_with_content(spark, str(root))), with_bytes=with_bytes)
    columns = [c for c in batch.columns if c != "pkt_no"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(map(tuple, batch.select(*columns).collect()), key=repr)
    # offsets order the packets of a capture as their numbers do, and nothing is there twice
    order = lambda rows: [[r.ts for r in sorted(rows, key=lambda r: r.pkt_no) if r.capture_id == c] for c in sorted({r.capture_id for r in rows})]
    assert order(got.select("capture_id", "pkt_no", "ts").collect()) == order(batch.select("capture_id", "pkt_no", "ts").collect())


def test_a_large_growing_capture_is_many_tasks(tmp_path):
    (tmp_path / "a.pcap").write_bytes(W.pcap(talk(400), start=1_700_000_000))
    (tmp_path / "b.pcapng").write_bytes(W.pcapng(talk(100)))
    reader = G.GrowingReader(str(tmp_path), "declared", True, 4000)
    end = reader.latestOffset()
    assert {p.rsplit("/", 1)[1] for p in end} == {"a.pcap", "b.pcapng"} and all(p.startswith("file:/") for p in end)
    parts = reader.partitions({}, end)
    assert len([p for p in parts if p.path.endswith("a.pcap")]) > 8
    assert len([p for p in parts if p.path.endswith("b.pcapng")]) == 1
    read = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sum(read) == 500 and max(read[:-1]) < 100
    assert reader.partitions(end, reader.latestOffset()) == []


def test_growing_captures_report_what_is_no_capture(spark, tmp_path):
    (tmp_path / "bad.pcap").write_bytes(b"nothing" * 10)
    G.ingest_growing(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    (row,) = D.capture_errors(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert row.error == "not a capture file"


def test_numeric_and_text_key_order_differ(spark):
    rows = spark.createDataFrame([(1, bytearray(W.pcap(talk(3))))], "capture_id bigint, content binary")
    packets = D.decode_frames(D.frames_from_content(rows))
    numeric = flow_packets(packets, FlowProfile("n")).select("port_a").distinct().collect()
    text = flow_packets(packets, PROCESSOR_STATS).select("ep_a").distinct().collect()
    assert [r.port_a for r in numeric] == [40000]
    assert [r.ep_a for r in text] == [B]


def test_images_from_capture_bytes(spark):
    frames = talk(6, payload=b"y" * 300)
    rows = spark.createDataFrame([(1, bytearray(W.pcap(frames)))], "capture_id bigint, content binary")
    packets = D.decode_frames(D.frames_from_content(rows))
    (row,) = flow_images(flow_packets(packets, UNIFIED), UNIFIED).select("image").collect()
    image = bytes(row.image)
    assert len(image) == 1600
    for i in range(5):
        block = image[320 * i : 320 * (i + 1)]
        ip = frames[i][14:]
        assert block[:40] == ip[:40] and block[40:80] == b"\x00" * 40
        assert block[80:] == ip[40:][:240]


def test_corpus_to_labelled_lengths(spark, tmp_path):
    for label, count in [("chat", 3), ("mail/x", 2)]:
        for i in range(count):
            path = tmp_path / label.split("/")[0] / f"{i}.pcap"
            path.parent.mkdir(exist_ok=True)
            path.write_bytes(W.pcap(talk(12 + i)))
    captures = C.captures_from_dirs(spark, str(tmp_path))
    profile = FlowProfile("test", payload_only=True)
    rows = corpus_features(captures, "lengths", profile, min_samples=3).collect()
    assert {(r.label, r.label_id) for r in rows} == {("chat", 0)}
    assert sorted(len(r.lengths) for r in rows) == [12, 13, 14]
    frame = 14 + 40 + 31
    assert rows[0].lengths[:4] == [frame, -frame, frame, frame]
    done = spark.createDataFrame([("chat",)], "label string")
    left = corpus_features(captures, "lengths", profile, min_samples=1, completed=done).collect()
    assert {r.label for r in left} == {"mail"}


def test_length_cap_and_minimum(spark):
    frames = talk(10, payload=b"z" * 2000)
    rows = spark.createDataFrame([(1, bytearray(W.pcap(frames)))], "capture_id bigint, content binary")
    keyed = flow_packets(D.decode_frames(D.frames_from_content(rows)), UNIFIED)
    (row,) = length_sequences(keyed, UNIFIED).collect()
    assert set(map(abs, row.lengths)) == {1500}
    assert length_sequences(keyed, UNIFIED, min_packets=11).count() == 0
    assert set(FLOW_KEY) <= set(length_sequences(keyed, UNIFIED).columns)


def small_captures(folder, count):
    folder.mkdir()
    for i in range(count):
        (folder / f"{i:04}.pcap").write_bytes(W.pcap(talk(5), start=1_700_000_000))


def test_small_captures_share_a_batch_of_frames(tmp_path):
    small_captures(tmp_path / "in", 40)
    paths = sorted(str(p) for p in (tmp_path / "in").iterdir())
    manifest = pa.RecordBatch.from_pydict({"capture_id": list(range(40)), "path": paths})
    (frames,) = D._path_reader(None)([manifest])
    assert frames["capture_id"].to_pylist() == [i for i in range(40) for _ in range(5)]
    contents = pa.RecordBatch.from_pydict({"capture_id": list(range(40)), "content": [open(p, "rb").read() for p in paths]})
    (from_content,) = D._content_reader(None)([contents])
    assert from_content.equals(frames)
    state = json.dumps(D._begin(io.BytesIO(open(paths[0], "rb").read())))
    ranges = [(i, p, 24, len(open(p, "rb").read()), 0, state, None) for i, p in enumerate(paths)]
    (from_ranges,) = D._chunk_reader(None)([D._batch(ranges, D._CHUNK_ARROW)])
    assert from_ranges.equals(frames)


def test_a_listing_is_a_bounded_number_of_tasks(spark, tmp_path):
    small_captures(tmp_path / "in", 600)
    listed = C.list_files(spark, str(tmp_path / "in"))
    assert listed.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert listed.count() == 600


def test_small_growing_captures_share_tasks(tmp_path):
    small_captures(tmp_path / "in", 40)
    end = G.GrowingReader(str(tmp_path / "in"), "declared", False, 200).latestOffset()
    single = G.GrowingReader(str(tmp_path / "in"), "declared", False, 200).partitions({}, end)
    shared = G.GrowingReader(str(tmp_path / "in"), "declared", False, 200, 4)
    parts = shared.partitions({}, end)
    assert 4 <= len(parts) <= 8 and len(single) > 80
    assert [r for p in parts for r in p.ranges] == single
    assert sum(b.num_rows for p in parts for b in shared.read(p)) == 200


def test_a_batch_holds_many_small_captures(spark, tmp_path):
    small_captures(tmp_path / "in", 1100)
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["batch=0"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5500


def test_capture_bytes_are_made_in_tasks_of_bounded_packets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "_TASK_PACKETS", 256)
    events = spark.range(4000).select(
        F.col("id").alias("event_id"),
        F.timestamp_micros(F.col("id") * 1000 + 10**15).alias("ts"),
        (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"),
        (F.col("id") % 50 / 10).alias("value"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    made = source_queries.capture_bytes(registry.Inputs(spark, str(tmp_path)))
    per_task = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 8 and sum(r["count"] for r in per_task) == 5 * 16
