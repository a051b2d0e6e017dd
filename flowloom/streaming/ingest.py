"""Incremental capture ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.functions.text import is_capture_file
from flowloom.session import staged
from flowloom.sources.decode import LARGE_BYTES, read_packets

# a batch holds paths only, and costs some jobs however few they are
FILES_PER_BATCH = 100_000
_BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_captures(
    spark: SparkSession, root: str, min_bytes: int = 0, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """Capture files as they appear below ``root``; only their paths are read here."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    return files.filter((F.col("length") >= min_bytes) & is_capture_file(F.col("path"))).select(
        F.xxhash64("path").alias("capture_id"), "path", "length"
    )


def ingest(
    spark: SparkSession,
    root: str,
    packets_path: str,
    checkpoint: str,
    link: str = "declared",
    min_bytes: int = 0,
    with_bytes: bool = True,
    large_bytes: int = LARGE_BYTES,
) -> StreamingQuery:
    """Decode all captures not seen yet and append their packets.

    Stops when nothing is left; calling it again with the same checkpoint resumes
    with the files that are new since. The captures of a batch are read as in a batch
    job, so one of ``large_bytes`` or more is many tasks. A batch has a folder of its own,
    which a batch that is repeated after a failure replaces.
    """

    def append(captures: DataFrame, batch: int) -> None:
        # the file source makes a task of every 30 files or so
        listed = captures.coalesce(4 * captures.sparkSession.sparkContext.defaultParallelism)
        packets = read_packets(staged(listed, "new-captures"), link, with_bytes, large_bytes)
        packets.write.mode("overwrite").parquet(f"{packets_path}/batch={batch}")

    return (
        stream_captures(spark, root, min_bytes)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
