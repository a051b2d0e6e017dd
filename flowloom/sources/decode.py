"""Capture files to packet rows.

Spark spreads files, or byte ranges of large files, over tasks. Inside a task a
generator walks the record headers, and the link, network and transport headers
of a whole Arrow batch are then taken apart at once with array operations.
"""

from __future__ import annotations

import io
import ipaddress
import json
import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.text import is_capture_file
from flowloom.profiles import TCP, UDP
from flowloom.schemas import PACKETS
from flowloom.session import staged

# Ship the functions of this module inside the task, so that executors do not need
# the package to be installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# File magics, block types, link types and protocol numbers.
PCAP_MAGICS = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
SECTION_BLOCK, INTERFACE_BLOCK, OLD_PACKET_BLOCK, PACKET_BLOCK = 0x0A0D0D0A, 1, 2, 6
SECTION_ORDER = 0x1A2B3C4D
LINK_NULL, LINK_ETHERNET, LINK_RAW, LINK_SLL, LINK_SLL2 = 0, 1, 101, 113, 276
ETHER_IPV4, ETHER_IPV6 = 0x0800, 0x86DD
VLAN_TAGS = (0x8100, 0x88A8, 0x9100)
ETHER_MPLS = (0x8847, 0x8848)
# IPv6 extension headers: options, routing, mobility, identity; fragment; authentication
IPV6_OPTIONS, IPV6_FRAGMENT, IPV6_AUTH = (0, 43, 60, 135, 139, 140), 44, 51
NULL_IPV4, NULL_IPV6 = (2,), (24, 28, 30)

READ_BUFFER = 4 * 1024 * 1024
CHUNK_BYTES = 64 * 1024 * 1024
# What a record may look like when its start has to be guessed.
SEARCH_BYTES = 1024 * 1024
MAX_RECORD = 262_144
MAX_CAPTURE_SECONDS = 10 * 365 * 86_400
LARGE_BYTES = 256 * 1024 * 1024
BYTE_COLUMNS = ("ip_header", "l4_header", "payload")
BATCH_FRAMES = 8192
BATCH_BYTES = 32 * 1024 * 1024

FRAME_SCHEMA = (
    "capture_id BIGINT, pkt_no BIGINT, ts_us BIGINT, datalink INT, frame_len INT, frame BINARY, error STRING"
)
CHUNK_SCHEMA = (
    "capture_id BIGINT, path STRING, start BIGINT, stop BIGINT, first_pkt BIGINT, state STRING, error STRING"
)
RANGE_SCHEMA = (
    "capture_id BIGINT, path STRING, low BIGINT, start BIGINT, stop BIGINT, n BIGINT, state STRING"
)
_RANGE_ARROW = pa.schema(
    [
        ("capture_id", pa.int64()),
        ("path", pa.string()),
        ("low", pa.int64()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("n", pa.int64()),
        ("state", pa.string()),
    ]
)
_FRAME_ARROW = pa.schema(
    [
        ("capture_id", pa.int64()),
        ("pkt_no", pa.int64()),
        ("ts_us", pa.int64()),
        ("datalink", pa.int32()),
        ("frame_len", pa.int32()),
        ("frame", pa.binary()),
        ("error", pa.string()),
    ]
)
_CHUNK_ARROW = pa.schema(
    [
        ("capture_id", pa.int64()),
        ("path", pa.string()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("first_pkt", pa.int64()),
        ("state", pa.string()),
        ("error", pa.string()),
    ]
)


def _begin(handle) -> dict:
    """Read the file header; the state is all that is needed to resume at a record."""
    handle.seek(0)
    head = handle.read(24)
    for endian in "<>":
        if len(head) == 24:
            (magic,) = struct.unpack(endian + "I", head[:4])
            if magic in PCAP_MAGICS:
                (link,) = struct.unpack(endian + "I", head[20:24])
                return {
                    "kind": "pcap",
                    "endian": endian,
                    "interfaces": [[link & 0xFFFF, PCAP_MAGICS[magic]]],
                    "at": 24,
                }
    if len(head) >= 12 and struct.unpack("<I", head[:4])[0] == SECTION_BLOCK:
        return {"kind": "pcapng", "endian": "<", "interfaces": [], "at": 0}
    raise ValueError("not a capture file")


def _pcap_records(handle, state, start, stop):
    endian = state["endian"]
    link, scale = state["interfaces"][0]
    header = struct.Struct(endian + "IIII")
    at = start
    handle.seek(at)
    while stop is None or at < stop:
        head = handle.read(16)
        if not head:
            return
        if len(head) < 16:
            raise ValueError("truncated record header")
        seconds, fraction, size, _ = header.unpack(head)
        ts = seconds * 1_000_000 + fraction * 1_000_000 // scale
        yield at, ts, link, size
        at += 16 + size
        handle.seek(at)


def _resolution(options: bytes, endian: str) -> int:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(endian + "HH", options, at)
        if code == 9 and size == 1:
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10**value
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def _pcapng_records(handle, state, start, stop):
    at = start
    while stop is None or at < stop:
        handle.seek(at)
        head = handle.read(12)
        if not head:
            return
        if len(head) < 12:
            raise ValueError("truncated block header")
        if struct.unpack("<I", head[:4])[0] == SECTION_BLOCK:
            state["endian"] = "<" if struct.unpack("<I", head[8:12])[0] == SECTION_ORDER else ">"
            state["interfaces"] = []
        endian = state["endian"]
        kind, length = struct.unpack(endian + "II", head[:8])
        if length < 12:
            raise ValueError("bad block length")
        if kind == INTERFACE_BLOCK:
            body = head[8:] + handle.read(length - 16)
            (link,) = struct.unpack_from(endian + "H", body)
            state["interfaces"].append([link, _resolution(body[8:], endian)])
        elif kind in (PACKET_BLOCK, OLD_PACKET_BLOCK):
            fixed = head[8:] + handle.read(16)
            if len(fixed) < 20:
                raise ValueError("truncated packet block")
            index = struct.unpack_from(endian + ("I" if kind == PACKET_BLOCK else "H"), fixed)[0]
            high, low, size = struct.unpack_from(endian + "III", fixed, 4)
            link, scale = state["interfaces"][index]
            yield at, ((high << 32) | low) * 1_000_000 // scale, link, size
        at += length


def _records(handle, state: dict, start: int, stop: int | None) -> Iterator[tuple]:
    """(offset, microseconds, link type, size) per record; the reader may read the frame next."""
    walk = _pcap_records if state["kind"] == "pcap" else _pcapng_records
    return walk(handle, state, start, stop)


def _pcap_frames(handle, state, start, stop, snap):
    """(microseconds, link type, length, kept bytes, error) per classic record.

    Records are unpacked from one buffer at a time; a record that does not end in it is
    carried over to the next.
    """
    link, scale = state["interfaces"][0]
    unpack = struct.Struct(state["endian"] + "IIII").unpack_from
    handle.seek(start)
    held, base, at = b"", start, 0
    while True:
        more = handle.read(READ_BUFFER)
        held, base, at = held[at:] + more, base + at, 0
        end = len(held)
        while stop is None or base + at < stop:
            if end - at < 16:
                break
            seconds, fraction, size, _ = unpack(held, at)
            body = at + 16
            if end - body < size and more:
                break
            whole = min(size, end - body)
            kept = held[body : body + (whole if snap is None else min(whole, snap))]
            ts = seconds * 1_000_000 + fraction * 1_000_000 // scale
            yield ts, link, whole, kept, None if whole == size else "truncated frame"
            at = body + whole
        else:
            return
        if not more:
            if at < end:
                raise ValueError("truncated record header")
            return


def _pcapng_frames(handle, state, start, stop, snap):
    for offset, ts, link, size in _pcapng_records(handle, state, start, stop):
        handle.seek(offset + 28)
        frame = handle.read(size)
        error = None if len(frame) == size else "truncated frame"
        yield ts, link, len(frame), frame if snap is None else frame[:snap], error


def _frames(handle, capture, start=None, stop=None, first=0, state=None, snap=None):
    """Rows of FRAME_SCHEMA; a broken file ends with one row that carries the error."""
    number = first
    try:
        state = state or _begin(handle)
        walk = _pcap_frames if state["kind"] == "pcap" else _pcapng_frames
        for ts, link, size, kept, error in walk(handle, state, state["at"] if start is None else start, stop, snap):
            yield capture, number, ts, link, size, kept, error
            number += 1
    except (ValueError, IndexError, struct.error, OSError) as problem:
        yield capture, number, None, None, None, None, str(problem)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and bytes; frames of many small captures share one."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5] or b"") if schema is _FRAME_ARROW else 64
        if len(held) >= BATCH_FRAMES or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def frames_from_content(contents: DataFrame, snap: int | None = None) -> DataFrame:
    """Frames of (capture_id, content) rows. Files must fit one binary value (2 GB)."""
    return contents.select("capture_id", "content").mapInArrow(_content_reader(snap), FRAME_SCHEMA)


def packets_from_content(
    contents: DataFrame, link: str = "declared", with_bytes: bool = True
) -> DataFrame:
    """Packets of (capture_id, content) rows, framed and decoded in one pass."""
    return contents.select("capture_id", "content").mapInArrow(
        _decoding(_content_reader(None), link, with_bytes), packet_schema(with_bytes)
    )


def _content_reader(snap: int | None) -> Callable:
    def frames(batches):
        for batch in batches:
            for capture, content in zip(batch["capture_id"].to_pylist(), batch["content"]):
                yield from _frames(io.BytesIO(content.as_buffer()), capture, snap=snap)

    return lambda batches: _batches(frames(batches), _FRAME_ARROW)


def _decoding(
    reader: Callable, link: str, with_bytes: bool, payload_bytes: int | None = None
) -> Callable:
    def run(batches):
        for frames in reader(batches):
            yield decode_batch(frames, link, with_bytes, payload_bytes)

    return run


def _unbuffered(path: str) -> pa.NativeFile:
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _open(path: str) -> io.BufferedReader:
    """A buffered handle on any file system Arrow knows (local, HDFS, object stores).

    Records are small against the buffer, so stepping from header to header stays
    inside it and storage sees large sequential reads.
    """
    return io.BufferedReader(_unbuffered(path), READ_BUFFER)


def sequential_chunks(captures: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Record-aligned byte ranges, found by walking each file's record headers in one task."""

    def walk(batches):
        for batch in batches:
            for capture, path in zip(batch["capture_id"].to_pylist(), batch["path"].to_pylist()):
                yield from _batches(chunks(capture, path), _CHUNK_ARROW)

    def chunks(capture, path):
        start, stop, first, number, saved = None, None, 0, 0, None
        error = None
        try:
            with _open(path) as handle:
                stop = handle.seek(0, io.SEEK_END)
                state = _begin(handle)
                start, saved = state["at"], json.dumps(state)
                for offset, *_ in _records(handle, state, state["at"], None):
                    if offset - start >= chunk_bytes:
                        yield capture, path, start, offset, first, saved, None
                        # the state as of this record: interfaces declared so far
                        start, first, saved = offset, number, json.dumps(state)
                    number += 1
        except (OSError, ValueError, IndexError, struct.error) as problem:
            error = str(problem)
        yield capture, path, start, stop, first, saved, error

    manifest = _spread(captures.select("capture_id", "path"), "path")
    return manifest.mapInArrow(walk, CHUNK_SCHEMA)


def _find_record(handle, state: dict, low: int, high: int) -> int | None:
    """First offset in [low, high) that looks like the start of a run of records.

    Only a guess: the caller accepts it when the walk of the range before ends there.
    """
    endian = state["endian"]
    scale = state["interfaces"][0][1]
    handle.seek(state["at"])
    (first_second,) = struct.unpack(endian + "I", handle.read(4))
    handle.seek(low)
    window = handle.read(min(high - low, SEARCH_BYTES) + 16)
    count = len(window) - 15
    if count <= 0:
        return None

    def word(at):
        # the overlapping words that begin at every byte
        return np.ndarray((count,), endian + "u4", window, at, (1,))

    size, original = word(8), word(12)
    plausible = (word(4) < scale) & (size > 0) & (size <= original) & (original <= MAX_RECORD)
    plausible &= np.abs(word(0).astype(np.int64) - first_second) < MAX_CAPTURE_SECONDS
    for candidate in np.flatnonzero(plausible).tolist():
        if _run_of_records(handle, state, low + candidate, first_second):
            return low + candidate
    return None


def _run_of_records(handle, state: dict, start: int, first_second: int, wanted: int = 32) -> bool:
    """Plausible records follow each other from ``start``, or up to the end of the file."""
    seen, end = 0, start
    try:
        for offset, ts, _, size in _pcap_records(handle, state, start, None):
            far = abs(ts // 1_000_000 - first_second) > MAX_CAPTURE_SECONDS
            if far or not 0 < size <= MAX_RECORD:
                return False
            seen, end = seen + 1, offset + 16 + size
            if seen == wanted:
                return True
    except ValueError:
        return False
    return end == handle.seek(0, io.SEEK_END) or seen >= wanted // 2


def walk_ranges(captures: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every classic capture cut into equal byte ranges, each walked by its own task.

    A range reports where its first record seems to start, where its last one ends
    and how many there are. Other formats give no rows.
    """
    ranges = captures.filter(F.col("length") > 0).select(
        "capture_id",
        "path",
        F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(chunk_bytes))).alias("low"),
    )

    def walk(batches):
        for batch in batches:
            rows = [attempted(row) for row in batch.to_pylist()]
            rows = [row for row in rows if row is not None]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, _RANGE_ARROW)], schema=_RANGE_ARROW
                )

    def attempted(row):
        try:
            return walked(row)
        except OSError:  # the walk from the beginning meets it again and reports it
            return None

    def walked(row):
        low, high = row["low"], row["low"] + chunk_bytes
        with _open(row["path"]) as handle:
            try:
                state = _begin(handle)
            except ValueError:
                return None
            if state["kind"] != "pcap":
                return None
            start = state["at"] if low == 0 else _find_record(handle, state, low, high)
            if start is None:
                return None
            stop, number = start, 0
            try:
                for offset, _, _, size in _pcap_records(handle, state, start, high):
                    stop, number = offset + 16 + size, number + 1
            except ValueError:
                pass
        return row["capture_id"], row["path"], low, start, stop, number, json.dumps(state)

    return _spread(ranges, "path", "low").mapInArrow(walk, RANGE_SCHEMA)


def capture_chunks(captures: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Record-aligned byte ranges of large captures, so that many tasks can decode one.

    The ranges of a classic capture are walked in parallel from guessed starts. The
    guesses are right if every range starts where the one before it ended and the
    last one reaches the end of the file, because the first start is known. A
    capture that fails this, or has another format, is walked from its beginning.
    """
    wanted = captures.select("capture_id", "path", "length")
    ranges = staged(walk_ranges(wanted, chunk_bytes), "ranges")
    along = Window.partitionBy("capture_id").orderBy("low")
    linked = ranges.withColumn("_before", F.lag("stop").over(along)).withColumn(
        "_linked", F.when(F.col("low") == 0, True).otherwise(F.col("start") == F.col("_before"))
    )
    sound = (
        linked.groupBy("capture_id")
        .agg(
            F.bool_and(F.coalesce("_linked", F.lit(False))).alias("_all"),
            F.min("low").alias("_low"),
            F.max("stop").alias("_end"),
        )
        .join(wanted.select("capture_id", "length"), "capture_id")
        # fewer bytes than a record header may be left over
        .filter(F.col("_all") & (F.col("_low") == 0) & (F.col("_end") + 16 > F.col("length")))
        .select("capture_id", "length", "_end")
    )
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    exact = (
        ranges.withColumn("first_pkt", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(sound, "capture_id")
        .select(
            "capture_id",
            "path",
            "start",
            F.when(F.col("stop") == F.col("_end"), F.greatest("stop", "length")).otherwise(F.col("stop")).alias("stop"),
            "first_pkt",
            "state",
            F.lit(None).cast("string").alias("error"),
        )
    )
    rest = wanted.join(sound.select("capture_id"), "capture_id", "left_anti")
    return exact.unionByName(sequential_chunks(rest, chunk_bytes))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread small rows that stand for much work.

    The partition count is explicit: rows of a manifest are tiny, and adaptive
    coalescing would otherwise put all files into one task.
    """
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *keys)


def _chunk_reader(snap: int | None) -> Callable:
    def range_frames(row):
        if row["state"] is None:
            yield row["capture_id"], 0, None, None, None, None, row["error"]
            return
        with _open(row["path"]) as handle:
            yield from _frames(
                handle,
                row["capture_id"],
                row["start"],
                row["stop"],
                row["first_pkt"],
                json.loads(row["state"]),
                snap,
            )

    def frames(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from range_frames(row)

    return lambda batches: _batches(frames(batches), _FRAME_ARROW)


def _path_reader(snap: int | None) -> Callable:
    def file_frames(capture, path):
        try:
            with _open(path) as handle:
                yield from _frames(handle, capture, snap=snap)
        except OSError as problem:
            yield capture, 0, None, None, None, None, str(problem)

    def frames(batches):
        for batch in batches:
            for capture, path in zip(batch["capture_id"].to_pylist(), batch["path"].to_pylist()):
                yield from file_frames(capture, path)

    return lambda batches: _batches(frames(batches), _FRAME_ARROW)


def frames_from_chunks(chunks: DataFrame, snap: int | None = None) -> DataFrame:
    """Frames of record-aligned byte ranges, spread over tasks by range."""
    return _spread(chunks, "capture_id", "start").mapInArrow(_chunk_reader(snap), FRAME_SCHEMA)


def frames_from_paths(captures: DataFrame, snap: int | None = None) -> DataFrame:
    """Frames of whole files, opened by the tasks from their paths; no content is shuffled."""
    manifest = _spread(captures.select("capture_id", "path"), "path")
    return manifest.mapInArrow(_path_reader(snap), FRAME_SCHEMA)


def packets_from_paths(
    captures: DataFrame, link: str = "declared", with_bytes: bool = True
) -> DataFrame:
    """Packets of whole files in the partitions the manifest already has; also for streams."""
    return captures.select("capture_id", "path").mapInArrow(
        _decoding(_path_reader(None), link, with_bytes), packet_schema(with_bytes)
    )


def packets_from_chunks(chunks: DataFrame, link: str = "declared", with_bytes: bool = True) -> DataFrame:
    """Packets of record-aligned byte ranges, framed and decoded by one task per range."""
    spread = _spread(chunks, "capture_id", "start")
    return spread.mapInArrow(_decoding(_chunk_reader(None), link, with_bytes), packet_schema(with_bytes))


def _by_size(captures: DataFrame, large_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Manifest of small files, and byte ranges of the large ones where sizes are known."""
    if "length" not in captures.columns:
        return _spread(captures.select("capture_id", "path"), "path"), None
    # a capture of unknown size is read whole
    small = captures.filter(F.coalesce("length", F.lit(0)) < large_bytes).select("capture_id", "path")
    large = capture_chunks(captures.filter(F.col("length") >= large_bytes))
    return _spread(small, "path"), _spread(large, "capture_id", "start")


def read_frames(
    captures: DataFrame, snap: int | None = None, large_bytes: int = LARGE_BYTES
) -> DataFrame:
    """Frames of every capture of a (capture_id, path, length) table.

    ``snap`` keeps only that many bytes of a frame; headers beyond are lost to a decoder.

    Captures of at least ``large_bytes`` are first cut into byte ranges, so one
    huge file does not become one task.
    """
    small, large = _by_size(captures, large_bytes)
    frames = small.mapInArrow(_path_reader(snap), FRAME_SCHEMA)
    if large is None:
        return frames
    return frames.unionByName(large.mapInArrow(_chunk_reader(snap), FRAME_SCHEMA))


def read_packets(
    captures: DataFrame,
    link: str = "declared",
    with_bytes: bool = True,
    large_bytes: int = LARGE_BYTES,
    payload_bytes: int | None = None,
) -> DataFrame:
    """Packets of a captures table; without bytes no header or payload bytes leave the reader.

    With ``payload_bytes`` no more than that of a payload does. Frames are decoded whole,
    so headers may lie as deep in a frame as they like. A capture that cannot
    be opened or read to its end gives a row with the ``error``.
    """
    small, large = _by_size(captures, large_bytes)
    schema = packet_schema(with_bytes)
    packets = small.mapInArrow(_decoding(_path_reader(None), link, with_bytes, payload_bytes), schema)
    if large is None:
        return packets
    decoded = large.mapInArrow(_decoding(_chunk_reader(None), link, with_bytes, payload_bytes), schema)
    return packets.unionByName(decoded)


def captures_with_content(spark: SparkSession, root: str, min_bytes: int = 0) -> DataFrame:
    """(capture_id, path, content) below ``root`` by the binary file source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return (
        files.filter(F.col("length") >= min_bytes)
        .filter(is_capture_file(F.col("path")))
        .select(F.xxhash64("path").alias("capture_id"), "path", "content")
    )


class _Bytes:
    """Positioned reads over all frames of a batch; past its end a frame reads as 0."""

    def __init__(self, frames: pa.BinaryArray):
        starts = np.frombuffer(frames.buffers()[1], np.int32)[frames.offset :][: len(frames) + 1]
        self.start = starts[:-1].astype(np.int64)
        self.stop = starts[1:].astype(np.int64)
        data = frames.buffers()[2]
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        if not len(self.data):
            self.data = np.zeros(1, np.uint8)

    def u8(self, at) -> np.ndarray:
        where = self.start + at
        inside = (where < self.stop) & (where >= self.start)
        return np.where(inside, self.data[np.where(inside, where, 0)], 0).astype(np.int64)

    def u16(self, at) -> np.ndarray:
        return (self.u8(at) << 8) | self.u8(at + 1)

    def cut(self, at: np.ndarray, size: np.ndarray, keep: np.ndarray) -> pa.Array:
        view = memoryview(self.data)
        begin = np.minimum(self.start + at, self.stop)
        end = np.minimum(begin + np.maximum(size, 0), self.stop)
        pieces = [
            bytes(view[b:e]) if k else None
            for b, e, k in zip(begin.tolist(), end.tolist(), keep.tolist())
        ]
        return pa.array(pieces, pa.binary())


def _version_of_type(ethertype: np.ndarray) -> np.ndarray:
    return np.select([ethertype == ETHER_IPV4, ethertype == ETHER_IPV6], [4, 6], 0)


def _behind_tags(data: _Bytes) -> tuple[np.ndarray, np.ndarray]:
    """IP version and header offset of Ethernet frames behind any VLAN tags and MPLS labels."""
    at = np.full(len(data.start), 12, np.int64)
    while True:
        tagged = np.isin(data.u16(at), VLAN_TAGS)  # reads past the end of a frame give 0
        if not tagged.any():
            break
        at += np.where(tagged, 4, 0)
    kind, at = data.u16(at), at + 2
    labelled = np.isin(kind, ETHER_MPLS)
    more = labelled.copy()
    while more.any():
        last = (data.u8(at + 2) & 1 == 1) | (data.start + at >= data.stop)
        at += np.where(more, 4, 0)
        more &= ~last
    inner = data.u8(at) >> 4
    behind = np.where(np.isin(inner, (4, 6)), inner, 0)
    return np.where(labelled, behind, _version_of_type(kind)), at


def _upper_layer(data: _Bytes, l3: np.ndarray, v6: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Protocol, header length and fragment offset of IPv6 packets behind extension headers."""
    proto, at = data.u8(l3 + 6), l3 + 40
    fragment = np.zeros(len(l3), np.int64)
    while True:
        options, auth, part = np.isin(proto, IPV6_OPTIONS), proto == IPV6_AUTH, proto == IPV6_FRAGMENT
        step = v6 & (options | auth | part) & (at + 8 <= end) & (fragment == 0)
        if not step.any():
            return proto, at - l3, fragment
        fragment = np.where(step & part, data.u16(at + 2) >> 3, fragment)
        size = np.select([options, auth], [8 * (data.u8(at + 1) + 1), 4 * (data.u8(at + 1) + 2)], 8)
        proto = np.where(step, data.u8(at), proto)
        at = np.where(step, at + size, at)


def _locate_ip(data: _Bytes, datalink: np.ndarray, link: str) -> tuple[np.ndarray, np.ndarray]:
    """IP version (0 where there is none) and offset of the IP header."""
    ethernet, ethernet_at = _behind_tags(data)
    cooked = _version_of_type(data.u16(np.int64(14)))
    first = data.u8(np.int64(0))
    nibble = first >> 4
    raw = np.where(np.isin(nibble, (4, 6)), nibble, 0)
    if link == "probe":
        # a link header counts only if the IP header behind it has the same version
        ethernet = np.where(data.u8(ethernet_at) >> 4 == ethernet, ethernet, 0)
        cooked = np.where(data.u8(np.int64(16)) >> 4 == cooked, cooked, 0)
        found = [ethernet > 0, cooked > 0]
        return np.select(found, [ethernet, cooked], raw), np.select(found, [ethernet_at, 16], 0)
    if link != "declared":
        raise ValueError(f"unknown link rule: {link}")
    family = np.where(first != 0, first, data.u8(np.int64(3)))
    loopback = np.select([np.isin(family, NULL_IPV4), np.isin(family, NULL_IPV6)], [4, 6], 0)
    cooked2 = _version_of_type(data.u16(np.int64(0)))
    kinds = [datalink == k for k in (LINK_ETHERNET, LINK_RAW, LINK_SLL, LINK_SLL2, LINK_NULL)]
    version = np.select(kinds, [ethernet, raw, cooked, cooked2, loopback], 0)
    return version, np.select(kinds, [ethernet_at, 0, 16, 20, 4], 0)


def _addresses(data: _Bytes, at: np.ndarray, v4: np.ndarray, ip: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Addresses as 16 big-endian bytes and as text, formatted once per distinct value."""
    wide = np.stack([data.u8(at + i) for i in range(16)], axis=1).astype(np.uint8)
    short = np.zeros_like(wide)
    short[:, 12:] = wide[:, :4]
    packed = np.where(v4[:, None], short, wide)
    keys = np.concatenate([packed, v4[:, None].astype(np.uint8)], axis=1)
    coded = pa.Array.from_buffers(pa.binary(17), len(keys), [None, pa.py_buffer(keys.tobytes())]).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    raw = [row[:16] for row in distinct]
    text = [
        str(ipaddress.IPv4Address(row[12:16])) if row[16] else ipaddress.IPv6Address(row[:16]).compressed
        for row in distinct
    ]
    index = pa.array(coded.indices.to_numpy(), mask=~ip)
    return pa.array(raw, pa.binary()).take(index), pa.array(text, pa.string()).take(index)


def packet_schema(with_bytes: bool) -> str:
    columns = [f for f in PACKETS.fields if with_bytes or f.name not in BYTE_COLUMNS]
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)


def decode_batch(
    frames: pa.RecordBatch, link: str, with_bytes: bool, payload_bytes: int | None = None
) -> pa.RecordBatch:
    """Packet rows of a batch of frames; a row without a frame keeps its error.

    ``payload_bytes`` cuts the stored payload; its length column stays that of the packet.
    """
    data = _Bytes(frames["frame"])
    size = frames["frame_len"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    datalink = frames["datalink"].fill_null(-1).to_numpy(zero_copy_only=False)
    framed = frames["frame"].is_valid().to_numpy(zero_copy_only=False)
    version, l3 = _locate_ip(data, datalink, link)
    v4 = version == 4
    header = np.where(v4, (data.u8(l3) & 15) * 4, 40)
    ip = framed & (version > 0) & (size - l3 >= np.where(v4, 20, 40)) & (header >= 20)
    length = data.u16(l3 + np.where(v4, 2, 4))
    # an IPv4 length of 0 stands for "all of the frame"
    stated = np.where(v4 & (length == 0), size, l3 + length + np.where(v4, 0, 40))
    end = np.minimum(stated, size)
    proto, beyond, later = _upper_layer(data, l3, ip & ~v4, end)
    header = np.where(v4, header, beyond)
    proto = np.where(v4, data.u8(l3 + 9), proto)
    fragment = np.where(v4, data.u16(l3 + 6) & 0x1FFF, later)
    l4 = l3 + header
    smallest = np.select([proto == TCP, proto == UDP], [20, 8], 0)
    skip = np.where(proto == TCP, (data.u8(l4 + 12) >> 4) * 4, 8)
    transport = (
        ip & (smallest > 0) & (fragment == 0) & (end - l4 >= smallest) & (skip >= smallest)
    )
    body = np.minimum(l4 + skip, end)
    other = ip & (smallest == 0)
    src_at = l3 + np.where(v4, 12, 8)
    src, src_text = _addresses(data, src_at, v4, ip)
    dst, dst_text = _addresses(data, src_at + np.where(v4, 4, 16), v4, ip)
    ints = lambda values, keep: pa.array(values.astype(np.int32), pa.int32(), mask=~keep)
    columns = {
        "capture_id": frames["capture_id"],
        "pkt_no": frames["pkt_no"],
        "ts": frames["ts_us"].cast(pa.timestamp("us", "UTC")),
        "ip_version": ints(version, ip),
        "src_ip": src,
        "dst_ip": dst,
        "src_ip_text": src_text,
        "dst_ip_text": dst_text,
        "sport": ints(data.u16(l4), transport),
        "dport": ints(data.u16(l4 + 2), transport),
        "proto": ints(proto, transport | other),
        "frame_len": frames["frame_len"],
        "payload_len": pa.array(np.where(transport, end - body, 0).astype(np.int32), mask=~framed),
    }
    if with_bytes:
        columns["ip_header"] = data.cut(l3, np.where(v4, 20, 40), ip)
        columns["l4_header"] = data.cut(l4, smallest, transport)
        kept = end - body if payload_bytes is None else np.minimum(end - body, payload_bytes)
        columns["payload"] = data.cut(body, kept, transport)
    columns["error"] = frames["error"]
    return pa.RecordBatch.from_pydict(columns)


def decode_frames(frames: DataFrame, link: str = "declared", with_bytes: bool = True) -> DataFrame:
    """Packet rows from a table of frames.

    ``link`` is "declared" (by the file's link type) or "probe" (Ethernet, then
    Linux cooked, then raw IP). Frames without an IP packet stay as rows with a
    null version, so that they can be counted. A TCP or UDP packet whose transport
    header is missing or cut, or that is a later fragment, gets a null protocol. A
    capture that could not be read to its end gives one more row with the ``error``.
    """

    def run(batches):
        for batch in batches:
            yield decode_batch(batch, link, with_bytes)

    columns = ["capture_id", "pkt_no", "ts_us", "datalink", "frame_len", "frame", "error"]
    return frames.select(*columns).mapInArrow(run, packet_schema(with_bytes))


def capture_errors(rows: DataFrame) -> DataFrame:
    """Captures that could not be read completely, with the reason; of frames or packets."""
    return rows.filter(F.col("error").isNotNull()).select("capture_id", "pkt_no", "error")
