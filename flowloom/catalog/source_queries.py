"""Readers and writers, checked on files that Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.registry import big, flow_key_id, query, r6
from flowloom.catalog.views import VIEWS
from flowloom.functions import sequences as S
from flowloom.operators import corpus
from flowloom.operators import features as X
from flowloom.operators import labels as L
from flowloom.operators import splits
from flowloom.operators.bursts import FLOW_TIMEOUT
from flowloom.operators.flows import flow_packets
from flowloom.plans import corpus_features, experiments
from flowloom.profiles import UNIFIED
from flowloom.session import staged, staging_path
from flowloom.sources import captures, datasets, decode, logs
from flowloom.streaming import bursts as stream_bursts
from flowloom.streaming.growing import ingest_growing
from flowloom.streaming.ingest import ingest

# --- capture bytes ---

_LINKS = (decode.LINK_ETHERNET, decode.LINK_RAW, decode.LINK_SLL, decode.LINK_SLL2, decode.LINK_NULL)
_BLOCK = 256
_TASK_PACKETS = 50_000


def _be(value, digits):
    return F.lpad(F.hex(value.cast("bigint")), digits, "0")


def _le(value):
    text = _be(value, 8)
    return F.concat(*[F.substring(text, p, 2) for p in (7, 5, 3, 1)])


def capture_bytes(q):
    """Packet table written as capture files, one per 256 packets of a capture.

    The files alternate between link types, byte orders and time resolutions.
    Ethernet frames keep the table's length; other link headers are longer or
    shorter, which shows in the frame length. Packets are brought together before their
    bytes are made, in tasks of about as many packets whatever the table's size.
    """
    rows = q.packets().withColumn("block", F.floor(F.col("pkt_no") / _BLOCK))
    tasks = max(int(q.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // _TASK_PACKETS))
    rows = rows.repartition(tasks, "capture_id", "block")
    rows = rows.withColumn("link", F.element_at(
        F.array(*[F.lit(x) for x in _LINKS]), (F.col("block") % len(_LINKS) + 1).cast("int")
    ))
    ip_ok = F.col("ip_version").isNotNull()
    options = F.when((F.col("proto") == 6) & (F.col("payload_len") > 0), 12).otherwise(0)
    head = F.when(F.col("proto") == 6, options + 20).otherwise(8)
    total = head + 20 + F.col("payload_len")
    address = lambda c: F.concat(F.lit("0A0000"), _be(F.col(c), 2))
    ip = F.concat(
        F.lit("4500"), _be(total, 4), F.lit("0000400040"), _be(F.col("proto"), 2), F.lit("0000"),
        address("src_ip"), address("dst_ip"),
    )
    ports = F.concat(_be(F.col("sport"), 4), _be(F.col("dport"), 4))
    tcp = F.concat(
        ports, F.lit("0000000000000000"), F.when(options > 0, F.lit("80")).otherwise(F.lit("50")),
        F.lit("10FFFF00000000"), F.repeat(F.lit("00"), options),
    )
    udp = F.concat(ports, _be(F.col("payload_len") + 8, 4), F.lit("0000"))
    l4 = F.when(F.col("proto") == 6, tcp).otherwise(udp)
    payload = F.repeat(F.lit("AB"), F.col("payload_len").cast("int"))
    datagram = F.concat(ip, l4, payload)
    kind = F.when(ip_ok, F.lit("0800")).otherwise(F.lit("0806"))
    link = F.col("link")
    frame = (
        F.when(link == 1, F.concat(F.lit("00" * 12), kind))
        .when(link == 101, F.when(ip_ok, F.lit("")).otherwise(F.lit("00")))
        .when(link == 113, F.concat(F.lit("00" * 14), kind))
        .when(link == 276, F.concat(kind, F.lit("00" * 18)))
        .otherwise(F.when(ip_ok, F.lit("02000000")).otherwise(F.lit("07000000")))
    )
    # short frames carry trailing padding that is not part of the IP packet
    bare = F.concat(frame, datagram)
    padded = F.rpad(bare, 128, "0")
    full = F.when(F.length(bare) < 128, padded).otherwise(bare)
    little = F.col("block") % 2 == 0
    nano = F.col("block") % 3 == 0
    word = lambda v: F.when(little, _le(v)).otherwise(_be(v, 8))
    micros = F.unix_micros("ts")
    fraction = F.when(nano, micros % 1_000_000 * 1000).otherwise(micros % 1_000_000)
    size = F.length("full") / 2
    record = F.concat(word(F.floor(micros / 1_000_000)), word(fraction), word(size), word(size), F.col("full"))
    magic = F.when(nano, F.lit(0xA1B23C4D)).otherwise(F.lit(0xA1B2C3D4))
    header = F.concat(
        word(magic),
        F.when(little, F.lit("02000400")).otherwise(F.lit("00020004")),
        F.lit("00" * 8),
        word(F.lit(262144)),
        word(link),
    )
    records = rows.withColumn("full", full).select(
        "capture_id", "block", "pkt_no", header.alias("header"), record.alias("record")
    )
    packed = F.sort_array(F.collect_list(F.struct(F.col("pkt_no").alias("k"), F.col("record").alias("v"))))
    return (
        records.groupBy("capture_id", "block")
        .agg(F.first("header").alias("header"), packed.alias("packed"))
        .select(
            (F.col("capture_id") * 1_000_000 + F.col("block")).alias("capture_id"),
            F.unhex(
                F.concat("header", F.array_join(F.transform("packed", lambda s: s["v"]), ""))
            ).alias("content"),
        )
    )


_BYTES_SQL = """WITH placed AS (SELECT *, capture_id * 1000000 + CAST(floor(pkt_id / 256) AS BIGINT) AS file_id,
  CAST(floor(pkt_id / 256) AS BIGINT) % 5 AS kind FROM packets),
sized AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pkt_id) - 1 AS file_pos,
  CASE kind WHEN 0 THEN 14 WHEN 1 THEN CASE WHEN ip_version IS NULL THEN 1 ELSE 0 END WHEN 2 THEN 16 WHEN 3 THEN 20 ELSE 4 END AS link_len,
  20 + CASE WHEN proto = 6 THEN CASE WHEN payload_len > 0 THEN 32 ELSE 20 END ELSE 8 END + payload_len AS total FROM placed)
"""


@query(
    "s6_decoded_packets",
    _BYTES_SQL
    + """SELECT file_id AS capture_id, CAST(file_pos AS BIGINT) AS pkt_no, epoch_us(ts) AS ts_us,
 CAST(CASE WHEN ip_version IS NULL THEN 0 ELSE 4 END AS BIGINT) AS ip_version, CASE WHEN ip_version IS NULL THEN '' ELSE src_ip_text END AS src,
 CASE WHEN ip_version IS NULL THEN '' ELSE dst_ip_text END AS dst,
 CAST(CASE WHEN ip_version IS NULL THEN -1 ELSE proto END AS BIGINT) AS proto,
 CASE WHEN ip_version IS NOT NULL AND proto IN (6, 17) THEN sport ELSE -1 END AS sport,
 CASE WHEN ip_version IS NOT NULL AND proto IN (6, 17) THEN dport ELSE -1 END AS dport,
 greatest(link_len + total, 64) AS frame_len,
 CASE WHEN ip_version IS NOT NULL AND proto IN (6, 17) THEN payload_len ELSE 0 END AS payload_len FROM sized""",
    ("packets",),
)
def _(q):
    packets = decode.packets_from_content(capture_bytes(q), with_bytes=False)
    filled = packets.fillna({"ip_version": 0, "proto": -1, "sport": -1, "dport": -1})
    return filled.select(
        *big("capture_id", "pkt_no", "ip_version", "proto", "sport", "dport", "frame_len", "payload_len"),
        F.unix_micros("ts").alias("ts_us"),
        F.coalesce("src_ip_text", F.lit("")).alias("src"),
        F.coalesce("dst_ip_text", F.lit("")).alias("dst"),
    )


@query(
    "s6_decoded_packet_bytes",
    _BYTES_SQL
    + """SELECT file_id AS capture_id, CAST(file_pos AS BIGINT) AS pkt_no, CAST(20 AS BIGINT) AS ip_header_len,
 CAST(CASE WHEN proto = 6 THEN 20 ELSE 8 END AS BIGINT) AS l4_header_len, repeat('AB', CAST(payload_len AS INT)) AS payload
FROM sized WHERE ip_version IS NOT NULL AND proto IN (6, 17)""",
    ("packets",),
)
def _(q):
    packets = decode.packets_from_content(capture_bytes(q)).filter("proto IN (6, 17)")
    return packets.select(
        *big("capture_id", "pkt_no"),
        F.length("ip_header").cast("bigint").alias("ip_header_len"),
        F.length("l4_header").cast("bigint").alias("l4_header_len"),
        F.hex("payload").alias("payload"),
    )


@query(
    "s7_packets_per_link_type",
    _BYTES_SQL
    + """SELECT CAST(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 101 WHEN 2 THEN 113 WHEN 3 THEN 276 ELSE 0 END AS BIGINT) AS datalink,
 count(*) AS n FROM sized GROUP BY kind""",
    ("packets",),
)
def _(q):
    frames = decode.frames_from_content(capture_bytes(q), snap=0)
    return frames.groupBy(F.col("datalink").cast("bigint").alias("datalink")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s7_link_probe",
    _BYTES_SQL
    + """SELECT file_id AS capture_id, count(*) AS n_frames, count(CASE WHEN ip_version IS NOT NULL AND kind <= 2 THEN 1 END) AS n FROM sized GROUP BY file_id""",
    ("packets",),
)
def _(q):
    """Every frame is probed; cooked v2 and loopback frames are not among what a probe finds."""
    frames = decode.frames_from_content(capture_bytes(q))
    packets = decode.decode_frames(frames, link="probe", with_bytes=False)
    return packets.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("ip_version") == 4).alias("n")
    )


def written_captures(q) -> str:
    """Capture files below one folder per site, written by the tasks that hold their bytes."""
    root = staging_path(q.spark, "captures")
    named = capture_bytes(q).withColumn(
        "label", F.concat(F.lit("site"), (F.floor(F.col("capture_id") / 1_000_000) % 3).cast("string"))
    )

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            labels, names = batch["label"].to_pylist(), batch["capture_id"].to_pylist()
            for label, name, content in zip(labels, names, batch["content"]):
                folder = f"{base}/{label}"
                if folder not in made:
                    system.create_dir(folder)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/{name}.pcap") as out:
                    out.write(content.as_buffer())
            yield batch.select(["capture_id"])

    named.mapInArrow(write, "capture_id BIGINT").write.format("noop").mode("overwrite").save()
    return root


_FILES_SQL = """, files AS (SELECT file_id, concat('site', CAST(capture_id % 3 AS VARCHAR)) AS label, kind,
 24 + sum(16 + greatest(link_len + total, 64)) AS length FROM sized GROUP BY file_id, capture_id, kind)
"""


@query(
    "s1_captures_from_dirs",
    _BYTES_SQL
    + _FILES_SQL
    + "SELECT label, count(*) AS n, CAST(sum(length) AS BIGINT) AS n_bytes FROM files WHERE length >= 20480 GROUP BY label",
    ("packets",),
)
def _(q):
    return _label_sizes(captures.captures_from_dirs(q.spark, written_captures(q), min_bytes=20480))


@query(
    "s1_captures_listed_by_tasks",
    _BYTES_SQL
    + _FILES_SQL
    + "SELECT label, count(*) AS n, CAST(sum(length) AS BIGINT) AS n_bytes FROM files WHERE length >= 20480 GROUP BY label",
    ("packets",),
)
def _(q):
    root = written_captures(q)
    return _label_sizes(captures.captures_from_dirs(q.spark, root, 20480, captures.list_tree))


def _label_sizes(listed):
    return listed.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").cast("bigint").alias("n_bytes")
    )


_TRAFFIC_SQL = """SELECT src_ip_text AS src, dst_ip_text AS dst, CAST(proto AS BIGINT) AS proto, count(*) AS n,
 CAST(sum(payload_len) AS BIGINT) AS n_payload, CAST(sum(greatest(link_len + total, 64)) AS BIGINT) AS n_bytes
FROM sized WHERE ip_version IS NOT NULL AND proto IN (6, 17) GROUP BY ALL"""


def _traffic(packets):
    return packets.filter("proto IN (6, 17)").groupBy(
        F.col("src_ip_text").alias("src"), F.col("dst_ip_text").alias("dst"), *big("proto")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("payload_len").cast("bigint").alias("n_payload"),
        F.sum("frame_len").cast("bigint").alias("n_bytes"),
    )


@query("s6_packets_from_files", _BYTES_SQL + _TRAFFIC_SQL, ("packets",))
def _(q):
    listed = staged(captures.captures_from_dirs(q.spark, written_captures(q)), "listed")
    return _traffic(decode.read_packets(listed, with_bytes=False))


@query("s6_packets_from_ranges", _BYTES_SQL + _TRAFFIC_SQL, ("packets",))
def _(q):
    listed = staged(captures.captures_from_dirs(q.spark, written_captures(q)), "listed")
    chunks = decode.capture_chunks(listed, chunk_bytes=32 * 1024)
    return _traffic(decode.packets_from_chunks(chunks, with_bytes=False))


@query("r3_incremental_ingest", _BYTES_SQL + _TRAFFIC_SQL, ("packets",))
def _(q):
    root = written_captures(q)
    out, checkpoint = staging_path(q.spark, "ingested"), staging_path(q.spark, "ingest-checkpoint")
    for _run in range(2):  # the second run finds nothing new
        ingest(q.spark, root, out, checkpoint, with_bytes=False).awaitTermination()
    return _traffic(q.spark.read.parquet(out))


@query("r3_growing_captures", _BYTES_SQL + _TRAFFIC_SQL, ("packets",))
def _(q):
    """The same packets from a stream of byte ranges; the second run finds that nothing has grown."""
    root = written_captures(q)
    out, checkpoint = staging_path(q.spark, "grown"), staging_path(q.spark, "grown-checkpoint")
    for _run in range(2):
        ingest_growing(q.spark, root, out, checkpoint, with_bytes=False, chunk_bytes=32 * 1024).awaitTermination()
    return _traffic(q.spark.read.parquet(out))


# --- captures to features and experiments ---

_FILE_FLOWS = (
    _BYTES_SQL
    + _FILES_SQL.replace("SELECT file_id, concat", "SELECT file_id, file_id % 4 AS part, concat")
    + """, big AS (SELECT * FROM files WHERE length >= 20480),
fwd AS (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND sport <= dport)) AS f FROM sized
 WHERE ip_version IS NOT NULL AND proto IN (6, 17) AND payload_len > 0 AND NOT (proto = 17 AND (sport = 5353 OR dport = 5353))),
file_flows AS (SELECT file_id, proto, CASE WHEN f THEN src_ip ELSE dst_ip END AS ea, CASE WHEN f THEN sport ELSE dport END AS pa,
 CASE WHEN f THEN dst_ip ELSE src_ip END AS eb, CASE WHEN f THEN dport ELSE sport END AS pb, count(*) AS n FROM fwd GROUP BY ALL),
named AS (SELECT file_flows.*, label, part FROM file_flows JOIN big ON file_flows.file_id = big.file_id)
"""
)


def _listed(q):
    """Capture files with a page type: a quarter homepages, a quarter subpages, the rest neither."""
    part = F.regexp_extract("path", r"/(\d+)\.pcap$", 1).cast("bigint") % 4
    page = F.when(part == 0, "homepage").when(part == 1, "subpage").otherwise("aggregate")
    return staged(captures.captures_from_dirs(q.spark, written_captures(q)).withColumn("page_type", page), "listed")


@query(
    "e4_families_from_files",
    _FILE_FLOWS
    + """, kept AS (SELECT 'lengths' AS family, label FROM named WHERE n >= 10 UNION ALL SELECT 'directions', label FROM named WHERE n >= 50
 UNION ALL SELECT 'statistics', label FROM named WHERE n >= 7 UNION ALL SELECT 'images', label FROM named WHERE n >= 5)
SELECT family, label, count(*) AS n, count(*) AS n_ids, TRUE AS printable FROM kept GROUP BY family, label HAVING count(*) >= 2""",
    ("packets",),
)
def _(q):
    read = corpus_features.corpus_families(_listed(q), link="declared", min_samples=2)
    printable = F.bool_and(F.col("sample_id").rlike("^[0-9A-Z:a-z.-]+$")).alias("printable")
    counts = [
        rows.groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("n_ids"), printable)
        .withColumn("family", F.lit(family))
        for family, rows in read.families.items()
    ]
    return corpus.union_all(counts).select("family", "label", "n", "n_ids", "printable")


_SPLIT_SIZES = """, sized_ AS (SELECT label, count(*) AS n FROM named WHERE n >= 5 AND {train} GROUP BY label),
train AS (SELECT label, 'train' AS split, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS n FROM sized_
 UNION ALL SELECT label, 'val', CAST(floor(n * 0.1::DOUBLE) AS BIGINT) FROM sized_
 {rest})
SELECT label, split, n FROM train WHERE n > 0"""
_TESTED = "UNION ALL SELECT label, 'test', count(*) FROM named WHERE n >= 5 AND {} GROUP BY label"
_ORDER = ["capture_path", "first_pkt"]


def _experiment(q, build):
    samples = staged(corpus_features.corpus_features(_listed(q), "images", link="declared", min_samples=1), "samples")
    pages = samples.filter("page_type <> 'aggregate'"), samples.filter("page_type = 'aggregate'")
    return build(*pages).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e5_homepage_experiment_from_files",
    _FILE_FLOWS + _SPLIT_SIZES.format(train="part = 0", rest=_TESTED.format("part <> 0")),
    ("packets",),
)
def _(q):
    return _experiment(q, lambda b, a: corpus.homepage_experiment(b, a, order=_ORDER))


@query(
    "e6_all_pages_experiment_from_files",
    _FILE_FLOWS + _SPLIT_SIZES.format(train="part <= 1", rest=_TESTED.format("part > 1")),
    ("packets",),
)
def _(q):
    return _experiment(q, lambda b, a: corpus.all_pages_experiment(b, a, order=_ORDER))


@query(
    "e7_aggregate_experiment_from_files",
    _FILE_FLOWS
    + _SPLIT_SIZES.format(
        train="part > 1",
        rest="UNION ALL SELECT label, 'test', n - CAST(floor(n * 0.8::DOUBLE) AS BIGINT) - CAST(floor(n * 0.1::DOUBLE) AS BIGINT) FROM sized_",
    ),
    ("packets",),
)
def _(q):
    return _experiment(q, lambda b, a: corpus.aggregate_experiment(a, order=_ORDER))


@query(
    "s6_read_errors",
    _BYTES_SQL
    + """SELECT file_id AS capture_id, CASE file_id % 7 WHEN 3 THEN 'truncated frame' WHEN 5 THEN 'not a capture file' ELSE '' END AS error,
 CASE WHEN file_id % 7 = 5 THEN 0 ELSE count(*) END AS n FROM sized GROUP BY file_id""",
    ("packets",),
)
def _(q):
    kind = F.col("capture_id") % 7
    content = (
        F.when(kind == 3, F.expr("substring(content, 1, length(content) - 5)"))
        .when(kind == 5, F.encode(F.lit("neither format"), "UTF-8"))
        .otherwise(F.col("content"))
    )
    packets = decode.packets_from_content(capture_bytes(q).withColumn("content", content), with_bytes=False)
    return packets.groupBy("capture_id").agg(
        F.coalesce(F.max("error"), F.lit("")).alias("error"), F.count("frame_len").alias("n")
    )


# --- label files ---


@query("s2_captures_from_csv", "SELECT path, label_id FROM captures", ("captures",))
def _(q):
    path = staging_path(q.spark, "label-map")
    q.captures().select("path", F.col("label_id").alias("label")).write.option("header", "true").csv(path)
    return captures.captures_from_csv(q.spark, path).select("path", *big("label_id"))


@query("s3_vocabulary_from_csv", "SELECT CAST(n_nationkey AS BIGINT) AS label_id, n_name AS label FROM nation")
def _(q):
    path = staging_path(q.spark, "vocabulary")
    q.table("nation").select(F.col("n_nationkey").alias("service_id"), F.col("n_name").alias("service")).write.option(
        "header", "true"
    ).csv(path)
    return captures.vocab_from_csv(q.spark, path).select(*big("label_id"), "label")


# --- datasets ---


@query(
    "s8_features_from_csv",
    """SELECT CAST(f2 AS BIGINT) AS f2, CAST(f3 AS BIGINT) AS f3, f1, label, dense_rank() OVER (ORDER BY label) - 1 AS label_id FROM features""",
    ("features",),
)
def _(q):
    path = staging_path(q.spark, "feature-csv")
    q.features().select("f1", "f2", "f3", "label").write.option("header", "true").csv(path)
    rows = datasets.features_from_csv(q.spark, path)
    return rows.select("f1", *big("f2", "f3", "label_id"), "label")


@query(
    "s9_sequence_json",
    """SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY pkt_seq) AS seq FROM sequences GROUP BY flow_id HAVING count(*) >= 20""",
    ("sequences",),
)
def _(q):
    path = staging_path(q.spark, "sequence-json")
    datasets.write_sequences(X.length_sequences(q.keyed(), UNIFIED), path, 10)
    rows = datasets.read_sequences(q.spark, path, 20)
    return rows.select(S.joined(F.col("lengths")).alias("seq"))


@query("s10_payload_column", "SELECT sample_id, n_chars AS payload FROM samples", ("samples",))
def _(q):
    rows = q.samples().select("sample_id", F.col("n_chars").alias("sequences"), F.lit(1).alias("X"))
    return datasets.select_payload(rows, ["sample_id"])


_SPLIT_ROWS = """WITH sp AS (SELECT sample_id, label, n_chars, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
 FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY sample_id) AS rn, count(*) OVER (PARTITION BY label_id) AS n FROM samples) t)
"""


def _written(q):
    """Samples by split and class folder."""
    path = staging_path(q.spark, "by-class")
    rows = splits.split_sequential(q.samples()).select(
        "sample_id", F.replace("label", F.lit("/"), F.lit("_")).alias("label"), "n_chars", "split"
    )
    datasets.write_by_class(rows.withColumnRenamed("n_chars", "features"), path)
    return path


@query(
    "s11_usable_classes",
    """WITH k AS (SELECT label, row_number() OVER (ORDER BY min(label_id)) - 1 AS label_id FROM samples GROUP BY label HAVING count(*) >= 10)
SELECT sample_id, replace(s.label, '/', '_') AS label, k.label_id FROM samples s JOIN k ON s.label = k.label""",
    ("samples",),
)
def _(q):
    label_map = L.class_table(q.samples(), ["label_id", "label"]).withColumn(
        "label", F.replace("label", F.lit("/"), F.lit("_"))
    )
    rows, _skipped = datasets.read_classes(q.spark, _written(q), label_map, "features")
    return rows.select("sample_id", "label", *big("label_id"))


@query(
    "s11_skipped_classes",
    """SELECT replace(label, '/', '_') AS label, count(*) AS n, 'too few samples' AS reason FROM samples GROUP BY label HAVING count(*) < 10
UNION ALL SELECT 'absent', 0, 'missing'""",
    ("samples",),
)
def _(q):
    known = L.class_table(q.samples(), ["label_id", "label"]).select(
        "label_id", F.replace("label", F.lit("/"), F.lit("_")).alias("label")
    )
    extra = q.spark.range(1).select(F.lit(9999).cast("bigint").alias("label_id"), F.lit("absent").alias("label"))
    _rows, skipped = datasets.read_classes(q.spark, _written(q), known.unionByName(extra), "features")
    return skipped.select("label", *big("n"), "reason")


@query("s12_combined_layouts", _SPLIT_ROWS + "SELECT sample_id, CASE split WHEN 'val' THEN 'val' ELSE split END AS split FROM sp", ("samples",))
def _(q):
    rows = staged(splits.split_sequential(q.samples()), "split")
    part = lambda name: rows.filter(F.col("split") == name).select("sample_id")
    both = datasets.combine_splits({"train": part("train"), "val": None, "test": part("test")})
    val = datasets.combine_splits({"all": rows.filter("split = 'val'").select("sample_id", "split")})
    return both.unionByName(val).select("sample_id", "split")


@query("s13_class_folders", _SPLIT_ROWS + "SELECT sample_id, replace(label, '/', '_') AS label, split, n_chars AS features FROM sp", ("samples",))
def _(q):
    return q.spark.read.parquet(_written(q)).select("sample_id", "label", "split", "features")


@query("s14_dataset_table", "SELECT sample_id, CASE WHEN isnan(f0) OR isinf(f0) THEN 0 ELSE f0 END AS f0, f1 FROM features", ("features",))
def _(q):
    path = staging_path(q.spark, "dataset")
    datasets.write_dataset(q.features(), path)
    return datasets.read_dataset(q.spark, path, ["f0", "f1"]).select("sample_id", "f0", "f1")


@query("s15_label_map", "SELECT DISTINCT label_id, label FROM samples", ("samples",))
def _(q):
    path = staging_path(q.spark, "label-map-json")
    datasets.write_label_map(L.class_table(q.samples(), ["label_id", "label"]), path, source="documents")
    return datasets.read_label_map(q.spark, path)


@query(
    "s16_class_counts_csv",
    'SELECT label AS "class", label_id AS class_id, count(*) AS "count" FROM samples GROUP BY label, label_id',
    ("samples",),
)
def _(q):
    path = staging_path(q.spark, "class-count")
    datasets.write_class_counts(q.samples(), path)
    return q.spark.read.schema("class STRING, class_id BIGINT, count BIGINT").option("header", "true").csv(path)


@query(
    "s16_dataset_meta",
    "SELECT count(DISTINCT label) AS num_classes, count(*) AS total_samples, 'direction_sequence' AS format FROM samples",
    ("samples",),
)
def _(q):
    return datasets.dataset_meta(q.samples(), format="direction_sequence")


@query(
    "s17_inventory",
    _SPLIT_ROWS + "SELECT split, replace(label, '/', '_') AS label, count(*) AS n FROM sp GROUP BY split, label",
    ("samples",),
)
def _(q):
    return datasets.inventory(q.spark.read.parquet(_written(q)))


@query("s17_inventory_totals", "SELECT count(*) AS total_samples, count(DISTINCT label) AS num_classes FROM samples", ("samples",))
def _(q):
    return datasets.inventory_totals(q.spark.read.parquet(_written(q)))


@query(
    "s18_one_split",
    _SPLIT_ROWS + "SELECT sample_id, replace(label, '/', '_') AS label FROM sp WHERE split = 'val'",
    ("samples",),
)
def _(q):
    return datasets.read_split(q.spark, _written(q), "val").select("sample_id", "label")


@query("s19_unlabelled_payloads", "SELECT n_chars AS payload FROM samples", ("samples",))
def _(q):
    payload, _per_file = datasets.read_unlabelled(q.spark, _written(q))
    return payload


@query("s19_samples_per_file_total", "SELECT CAST(count(*) AS BIGINT) AS n FROM samples", ("samples",))
def _(q):
    _payload, per_file = datasets.read_unlabelled(q.spark, _written(q))
    return per_file.agg(F.sum("n").alias("n"))


# --- logs ---


def _log_lines(q, line):
    """One text line per epoch and run, in the form a log reader gives them."""
    return q.history().select("run", F.col("epoch").alias("line_no"), line.alias("line"))


def _epoch_line():
    number = lambda c: F.format_string("%.6f", c)
    return F.concat(
        F.lit("Epoch "), F.lpad(F.col("epoch").cast("string"), 3, " "),
        F.lit(" | Train Loss: "), number(F.col("metric") * 10), F.lit(" | Train Acc: "), number(F.col("metric")),
        F.lit(" | Val Acc: "), number(F.col("metric") * 2), F.lit(" | Val F1: "), number(F.col("metric") * 3),
        F.when(F.col("epoch") % 3 == 1, F.lit(" *")).otherwise(F.lit("")),
    )


@query(
    "s21_epoch_history",
    """SELECT run, CAST(epoch AS BIGINT) AS epoch, round(metric * 10, 5) AS train_loss, round(metric * 2, 5) AS val_acc, epoch % 3 = 1 AS is_best FROM history WHERE NOT isnan(metric)""",
    ("history",),
)
def _(q):
    parsed = logs.epoch_history(_log_lines(q, _epoch_line()))
    return parsed.select(
        "run",
        "epoch",
        (F.round("train_loss", 5) + 0.0).alias("train_loss"),
        (F.round("val_acc", 5) + 0.0).alias("val_acc"),
        "is_best",
    )


def _result_lines(q):
    line = F.when(F.col("epoch") % 2 == 0, F.concat(F.lit("Accuracy:  "), F.format_string("%.6f", "metric")))
    f1 = F.concat(F.when(F.col("epoch") % 4 == 1, F.lit("F1 Score: ")).otherwise(F.lit("F1: ")), F.format_string("%.6f", "metric"))
    return _log_lines(q, F.coalesce(line, f1))


_RESULTS = """SELECT run, round(max_by(metric, epoch) FILTER (WHERE epoch % 2 = 0 AND NOT isnan(metric)), 6) AS accuracy,
 round(max_by(metric, epoch) FILTER (WHERE epoch % 2 = 1 AND NOT isnan(metric)), 6) AS f1 FROM history GROUP BY run"""


@query("s20_run_results", _RESULTS, ("history",))
def _(q):
    return logs.run_results(_result_lines(q))


@query("s20_run_results_from_files", _RESULTS, ("history",))
def _(q):
    path = staging_path(q.spark, "logs")
    lines = F.sort_array(F.collect_list(F.struct(F.col("line_no").alias("k"), F.col("line").alias("v"))))
    text = F.array_join(F.transform(lines, lambda s: s["v"]), "\n")
    _result_lines(q).groupBy("run").agg(text.alias("value")).write.partitionBy("run").text(path)
    return logs.run_results(logs.read_log_lines(q.spark, path, run_folder=True))


@query(
    "g40_experiment_summary",
    f"SELECT 2 * count(*) AS n_runs, count(*) AS n_success, round(avg(accuracy), 6) AS mean_accuracy, round(avg(f1), 6) AS mean_f1 FROM ({_RESULTS}) r",
    ("history",),
)
def _(q):
    lines = _result_lines(q)
    # every run has a twin that failed: its log states no result
    failed = lines.select(F.concat(F.lit("failed-"), "run").alias("run"), "line_no", F.lit("Traceback").alias("line"))
    s = logs.experiment_summary(logs.run_results(lines.unionByName(failed)))
    return s.select(*big("n_runs", "n_success"), r6("mean_accuracy").alias("mean_accuracy"), r6("mean_f1").alias("mean_f1"))


# --- streams ---


_STREAMED = """WITH marked AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY flow_id ORDER BY ts, pkt_id) >= {gap} THEN 1 ELSE 0 END AS fresh FROM flow_packets),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY flow_id ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING) AS burst FROM marked),
bursts AS (SELECT flow_id, burst, count(*) AS n_packets, CAST(sum(frame_len) AS BIGINT) AS n_bytes, max(epoch_us(ts)) AS last_us FROM numbered GROUP BY flow_id, burst)
SELECT flow_id, n_packets, n_bytes, last_us FROM bursts"""


@query("r1_stream_bursts", _STREAMED.format(gap=1800000000), ("flow_packets",))
def _(q):
    """Bursts at a 30-minute gap: those the watermark closed on a stream, and those still in its state."""
    return _streamed(q, 1800.0)


@query("r2_stream_flow_timeout", _STREAMED.format(gap=60000000), ("flow_packets",))
def _(q):
    """Flows ended by a minute of silence, on a stream."""
    return _streamed(q, FLOW_TIMEOUT)


def _streamed(q, gap):
    events = q.table("events")
    stream = (
        q.spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(q.root)
    )
    stream.createOrReplaceTempView("streamed_events")
    sql = VIEWS["packets"].sql.replace("FROM events)", "FROM streamed_events)")
    rows = q.spark.sql(sql).withColumnRenamed("pkt_id", "pkt_no")
    packets = flow_packets(rows.withColumn("ts", F.col("ts").cast("timestamp")), UNIFIED)
    out = stream_bursts.stream_bursts(packets, gap, late="0 seconds")
    path, checkpoint = staging_path(q.spark, "bursts"), staging_path(q.spark, "bursts-checkpoint")
    job = (
        out.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    job.awaitTermination()
    closed = q.spark.read.schema(out.schema).parquet(path)
    done = closed.unionByName(stream_bursts.open_bursts(q.spark, checkpoint))
    return done.select(flow_key_id(), *big("n_packets", "n_bytes"), F.unix_micros("last_ts").alias("last_us"))


# --- whole chains ---


@query(
    "e1_labelled_statistics",
    """WITH f AS (SELECT flow_id, capture_id FROM flow_packets GROUP BY flow_id, capture_id HAVING count(*) >= 7),
n AS (SELECT f.flow_id AS sample_id, concat('site', CAST(c.label_id AS VARCHAR)) AS label, frame FROM f JOIN captures c ON f.capture_id = c.capture_id
 JOIN (SELECT flow_id, round(avg(frame_len), 6) AS frame FROM flow_packets WHERE pkt_seq <= 260 GROUP BY flow_id) m ON f.flow_id = m.flow_id),
k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM n GROUP BY label HAVING count(*) >= 10)
SELECT sample_id, n.label, label_id, frame AS bi_mean FROM n JOIN k ON n.label = k.label""",
    ("flow_packets", "captures"),
)
def _(q):
    labelled = q.captures().withColumn("label", F.concat(F.lit("site"), F.col("label_id").cast("string")))
    rows = corpus_features.labelled_features(q.packets(), labelled, "statistics")
    return rows.select("sample_id", "label", *big("label_id"), r6("bi_mean").alias("bi_mean"))


@query(
    "e3_split_fit_score",
    """WITH c AS (SELECT count(*) AS n FROM decided), s AS (SELECT 'val' AS split, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS n FROM c
 UNION ALL SELECT 'test', n - CAST(floor(n * 0.8::DOUBLE) AS BIGINT) - CAST(floor(n * 0.1::DOUBLE) AS BIGINT) FROM c)
SELECT split, n, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS confidence_accuracy, 1.0::DOUBLE AS confidence_ratio FROM s""",
    ("decided",),
)
def _(q):
    rows = L.encode_labels(q.view("decided"))
    scores = experiments.split_and_score(rows, ["f0", "f1", "f2", "f3", "f4"], threshold=0.5)
    rounded = [r6(c).alias(c) for c in ("accuracy", "confidence_accuracy", "confidence_ratio")]
    return scores.select("split", *big("n"), *rounded)


@query(
    "e3b_curated_top_k",
    """WITH sp AS (SELECT *, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
 FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY md5(concat(CAST(42 + label_id AS VARCHAR), ':', CAST(sample_id AS VARCHAR))), sample_id) AS rn,
 count(*) OVER (PARTITION BY label_id) AS n FROM samples) t WHERE n >= 10),
k AS (SELECT label_id, label, row_number() OVER (ORDER BY count(*) DESC, label_id) AS r FROM sp WHERE split = 'val' GROUP BY label_id, label),
m AS (SELECT label_id, row_number() OVER (ORDER BY label) - 1 AS new_id FROM k WHERE r <= 5)
SELECT sample_id, split, new_id AS label_id FROM sp JOIN m ON sp.label_id = m.label_id""",
    ("samples",),
)
def _(q):
    rows = experiments.curated_top_k(q.samples(), 5)
    return rows.select("sample_id", "split", *big("label_id"))
