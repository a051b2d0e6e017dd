"""Captures that grow while they are read: a stream source whose offsets are byte positions."""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from flowloom.sources import decode as D

# the source runs in Python processes of its own, which need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "growing_captures"
# Endings of capture files
_ENDINGS = (".pcap", ".pcapng")
_NEXT_GENERATION = b"\n\r\r\n"
# what opening a file and finding a record in it counts as, in bytes read
_OPEN_BYTES = 64 * 1024


@dataclass
class ByteRange(InputPartition):
    """Records of ``path`` that end after byte ``low`` and not after byte ``high``."""

    path: str
    low: int
    high: int


@dataclass
class ByteRanges(InputPartition):
    """Ranges that one task reads one after the other."""

    ranges: list[ByteRange]


def _dealt(ranges: list[ByteRange], tasks: int) -> list[InputPartition]:
    """Ranges as they are if there are few, else in runs of about ``CHUNK_BYTES`` of work or less.

    So many small files, or what many files have grown by, are not as many tasks.
    """
    if len(ranges) <= tasks:
        return ranges
    work = [r.high - r.low + _OPEN_BYTES for r in ranges]
    wanted = min(sum(work) / tasks, D.CHUNK_BYTES)
    runs, held, size = [], [], 0
    for part, cost in zip(ranges, work):
        if held and size + cost > wanted:
            runs.append(ByteRanges(held))
            held, size = [], 0
        held.append(part)
        size += cost
    return [*runs, ByteRanges(held)]


def _sizes(root: str) -> dict[str, int]:
    """Size of every capture file below ``root``, by the path Spark lists it under."""
    from pyarrow import fs

    text = "/" + root[5:].lstrip("/") if root.startswith("file:") else root
    system, base = fs.FileSystem.from_uri(text)
    place = root[: root.index(base)] if "://" in root and not root.startswith("file:") else "file:"
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return {
        place + info.path: info.size
        for info in found
        if info.type == fs.FileType.File and info.size and info.path.lower().endswith(_ENDINGS)
    }


def _reaching(handle, state: dict, start: int, low: int) -> int | None:
    """Offset of the first record from ``start`` on that ends after ``low``."""
    try:
        for offset, _, _, size in D._pcap_records(handle, state, start, None):
            if offset + 16 + size > low:
                return offset
    except ValueError:  # the last record header is not complete yet
        pass
    return None


def _first_record(handle, state: dict, low: int) -> int | None:
    """First record that ends after ``low``, from two guessed starts that must agree.

    If they do not, or no start is found, records are walked from the beginning.
    """
    if low <= state["at"]:
        return state["at"]
    reached = []
    for back in (1, 2):
        begin = max(state["at"], low - back * (D.MAX_RECORD + 16))
        if begin == state["at"]:  # no guess: both would be the first record
            break
        guess = D._find_record(handle, state, begin, low)
        reached.append(None if guess is None else _reaching(handle, state, guess, low))
    if len(reached) == 2 and reached[0] is not None and reached[0] == reached[1]:
        return reached[0]
    return _reaching(handle, state, state["at"], low)


def _frames_between(handle, part: ByteRange) -> Iterator[tuple]:
    """(offset, microseconds, link type, length, kept bytes) of the records of a range."""
    state = D._begin(handle)
    if state["kind"] == "pcap":
        at = _first_record(handle, state, part.low)
        if at is None or at >= part.high:
            return
        try:
            for ts, link, size, kept, error in D._pcap_frames(handle, state, at, part.high, None):
                end = at + 16 + size
                if error or end > part.high:  # not complete in this range
                    return
                yield at, ts, link, size, kept
                at = end
        except ValueError:
            return
        return
    # blocks carry no mark to start at, and interfaces may be described anywhere
    try:
        for offset, ts, link, size in D._pcapng_records(handle, state, state["at"], part.high):
            end = offset + 28 + size
            if part.low < end <= part.high:
                handle.seek(offset + 28)
                yield offset, ts, link, size, handle.read(size)
    except ValueError as problem:
        if "truncated" not in str(problem):
            raise


def _rows(part: ByteRange) -> Iterator[tuple]:
    capture = xxhash.xxh64_intdigest(part.path.encode(), seed=42)
    capture -= (capture >> 63) << 64
    try:
        with D._open(part.path) as handle:
            if handle.seek(0, io.SEEK_END) < 24:
                return
            for offset, ts, link, size, kept in _frames_between(handle, part):
                yield capture, offset, ts, link, size, kept, None
    except (ValueError, IndexError, OSError) as problem:
        yield capture, part.low, None, None, None, None, str(problem)


class GrowingCaptures(DataSource):
    """Options: ``path``, ``link``, ``with_bytes``, ``chunk_bytes``, ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _flag(self, name: str, default: str) -> str:
        return str(self.options.get(name, default)).lower()

    def schema(self) -> str:
        return D.packet_schema(self._flag("with_bytes", "true") == "true")

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return GrowingReader(
            self.options["path"],
            self._flag("link", "declared"),
            self._flag("with_bytes", "true") == "true",
            int(self._flag("chunk_bytes", str(D.CHUNK_BYTES))),
            int(self._flag("tasks", "0")) or None,
        )


class GrowingReader(DataSourceStreamReader):
    """An offset is the size every file has been read to; a batch is what they have grown by."""

    def __init__(self, root: str, link: str, with_bytes: bool, chunk_bytes: int, tasks: int | None = None):
        self.root, self.link, self.with_bytes, self.chunk_bytes = root, link, with_bytes, chunk_bytes
        self.tasks = tasks

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return _sizes(self.root)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = []
        for path in sorted(end):
            low, high = start.get(path, 0), end[path]
            if high <= low:
                continue
            step = self.chunk_bytes
            if high - low > step:
                with D._unbuffered(path) as handle:
                    step = high - low if handle.read(4) == _NEXT_GENERATION else step
            ranges += [ByteRange(path, at, min(at + step, high)) for at in range(low, high, step)]
        return ranges if self.tasks is None else _dealt(ranges, self.tasks)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        ranges = partition.ranges if isinstance(partition, ByteRanges) else [partition]
        rows = (row for part in ranges for row in _rows(part))
        for frames in D._batches(rows, D._FRAME_ARROW):
            yield D.decode_batch(frames, self.link, self.with_bytes)


def stream_growing_captures(
    spark: SparkSession,
    root: str,
    link: str = "declared",
    with_bytes: bool = True,
    chunk_bytes: int = D.CHUNK_BYTES,
) -> DataFrame:
    """Packets of the captures below ``root`` as the files appear and grow.

    What a classic capture has grown by is cut into ranges of ``chunk_bytes``, and the next
    batch goes on at the byte where this one ended. Few ranges have a task each, many are
    dealt to tasks that read several (`_dealt`), so a task is not started for every file. A
    range finds its first record by itself: two guesses from different distances must
    meet at the same record, else the records are walked from the start of the file. A
    record belongs to the range in which it ends, so one still being written is left for
    later. ``pkt_no`` is the byte offset of the record, which orders the packets of a
    capture as their numbers do. Next-generation captures are read by one task per batch.
    The offset has one entry per file; for trees of very many finished captures use
    `flowloom.streaming.ingest`. A file that gets shorter is not read again.
    """
    spark.dataSource.register(GrowingCaptures)
    return (
        spark.readStream.format(FORMAT)
        .option("path", root)
        .option("link", link)
        .option("with_bytes", str(with_bytes).lower())
        .option("chunk_bytes", str(chunk_bytes))
        .option("tasks", str(4 * spark.sparkContext.defaultParallelism))
        .load()
    )


def ingest_growing(
    spark: SparkSession,
    root: str,
    packets_path: str,
    checkpoint: str,
    link: str = "declared",
    with_bytes: bool = True,
    chunk_bytes: int = D.CHUNK_BYTES,
) -> StreamingQuery:
    """Append the packets that captures have gained since the last call with this checkpoint."""
    packets = stream_growing_captures(spark, root, link, with_bytes, chunk_bytes)
    return (
        packets.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(packets_path)
    )
