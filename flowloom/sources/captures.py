"""Capture and sample-file tables from folder trees and label files."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import text as X
from flowloom.operators.labels import dense_ids
from flowloom.session import staged

# the functions of this module travel inside the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Listing = Callable[..., DataFrame]
_ENTRIES = "path STRING, length BIGINT, is_folder BOOLEAN"
_LISTED_ROWS = 10_000


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Paths and sizes below ``root``; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # the file source makes a task of every 30 files or so, each with a file of its own once staged
    tasks = 4 * spark.sparkContext.defaultParallelism
    return reader.load(root).select("path", "length").coalesce(tasks)


def list_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """`list_files` for trees of any number of files: folders are listed by tasks.

    The tree is walked level by level. The folders of a level are dealt to tasks, each
    lists its folders one by one, and what they hold is written to shared storage; the
    folders found are the next level. No file status reaches the driver, which only
    learns whether a level has further folders. ``root`` must be on a file system that
    Arrow opens. As in `list_files`, names that begin with a dot or an underscore are
    passed over; empty files, which the file source leaves out, are listed.
    """
    level = spark.createDataFrame([(root,)], "path STRING")
    found = None
    while True:
        # a stated number of partitions, which adaptive execution leaves as it is
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        entries = staged(level.repartition(tasks, "path").mapInArrow(_listed, _ENTRIES), "listing")
        files = entries.filter(~F.col("is_folder"))
        found = files if found is None else found.unionByName(files)
        level = entries.filter(F.col("is_folder")).select("path")
        if level.isEmpty():
            break
    if glob:
        pattern = "/" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in glob) + "$"
        found = found.filter(F.col("path").rlike(pattern))
    return found.select("path", "length")


def _listed(batches):
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            for part in _folder_entries(folder):
                yield part


def _folder_entries(folder: str):
    """Entries of a folder, in batches; paths are spelled as Spark spells them."""
    local = "://" not in folder
    name = "/" + folder.removeprefix("file:").lstrip("/") if local or folder.startswith("file:") else folder
    system, base = fs.FileSystem.from_uri(name)
    place = "file:" if name.startswith("/") else name[: name.index(base)]
    entries = system.get_file_info(fs.FileSelector(base, recursive=False))
    kept = [e for e in entries if not e.base_name.startswith((".", "_"))]
    for at in range(0, len(kept), _LISTED_ROWS):
        part = kept[at : at + _LISTED_ROWS]
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([place + e.path for e in part], pa.string()),
                "length": pa.array([e.size for e in part], pa.int64()),
                "is_folder": pa.array([e.type == fs.FileType.Directory for e in part], pa.bool_()),
            }
        )


def capture_id(path: Column) -> Column:
    return F.xxhash64(path)


def captures_from_dirs(
    spark: SparkSession, root: str, min_bytes: int = 0, listing: Listing = list_files
) -> DataFrame:
    """Captures below ``root``, labelled by their first-level folder.

    The size test is pushed into the listing; `list_tree` lists trees of very many files.
    """
    files = listing(spark, root).filter(F.col("length") >= min_bytes)
    return (
        files.filter(X.is_capture_file(F.col("path")))
        .withColumn("label", X.first_level_label(F.col("path"), root))
        .filter(F.col("label").isNotNull())
        .withColumn("capture_id", capture_id(F.col("path")))
    )


def large_enough(captures: DataFrame, min_bytes: int) -> DataFrame:
    """Captures of at least ``min_bytes``; those of unknown size are kept."""
    return captures.filter(F.col("length").isNull() | (F.col("length") >= min_bytes))


def captures_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, label) CSV with header."""
    rows = spark.read.schema("path STRING, label_id BIGINT").option("header", "true").csv(path)
    return rows.withColumn("capture_id", capture_id(F.col("path")))


def vocab_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Class names by position: whatever the header calls them, id then name."""
    return spark.read.schema("label_id BIGINT, label STRING").option("header", "true").csv(path)


def with_page_types(files: DataFrame) -> DataFrame:
    """Label and page type of captures in a batch/single tree; other files are dropped."""
    path = F.col("path")
    return (
        files.withColumn("page_type", X.page_type(path))
        .filter(F.col("page_type").isNotNull())
        .withColumn("label", X.site_label(path))
    )


def ablation_captures(spark: SparkSession, root: str, listing: Listing = list_files) -> DataFrame:
    """Aggregate, homepage and subpage captures with label ids over all site names."""
    files = listing(spark, root, "*.pcap")
    typed = with_page_types(files).withColumn("capture_id", capture_id(F.col("path")))
    sites = dense_ids(staged(all_sites(typed), "sites"), ["label"], "label_id")
    return typed.join(sites, "label")


def all_sites(captures: DataFrame) -> DataFrame:
    """Distinct labels seen in either half of the tree."""
    return captures.select("label").distinct()


def parse_sample_paths(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """split / class folder names of sample files; class ids by sorted class name."""
    pattern = r"([^/]+)/([^/]+)/[^/]+\.(" + "|".join(suffixes) + ")$"
    parsed = files.select(
        "*",
        F.regexp_extract("path", pattern, 1).alias("split"),
        F.regexp_extract("path", pattern, 2).alias("label"),
    ).filter(F.col("label") != "")
    classes = dense_ids(staged(parsed.select("label").distinct(), "classes"), ["label"], "label_id")
    return parsed.join(classes, "label")


def sample_tree(
    spark: SparkSession,
    root: str,
    suffixes: tuple[str, ...] = ("json", "pcap", "png"),
    listing: Listing = list_files,
) -> DataFrame:
    return parse_sample_paths(listing(spark, root), suffixes)
