"""Pieces that several operators of this subpackage share.

* ``table``: one of the input tables.
* ``stage`` / ``remove``: write an intermediate table once to the shared folder of
  ``spark.checkpoint.dir`` and read it back, which cuts lineage and survives lost
  executors; intermediates that no later step reads are removed.
* ``components``: connected components by alternating large-star and small-star.
* ``frugal`` / ``whole_texts``: bounds on what a Python worker holds.
* ``word_hashes`` / ``shingle_hashes``: 64-bit hashes of the words of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import staging_path

# entries of each memo of a Python worker; it is emptied when full and after each task
MEMO_WORDS = 250_000
# rows per Arrow batch: a worker holds a few batches of whole texts at a time
BATCH_ROWS = 2000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_memos: list[dict] = []


def new_memo() -> dict:
    """A dictionary that lives as long as a task does."""
    memo: dict = {}
    _memos.append(memo)
    return memo


def forget() -> None:
    for memo in _memos:
        memo.clear()


def frugal(fn: Callable) -> Callable:
    """``fn`` over the batches of a task, leaving no memo behind for the worker's next one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        try:
            yield from fn(batches)
        finally:
            forget()

    return run


_words = new_memo()


def whole_texts(df: DataFrame) -> DataFrame:
    """``df``; batches of its session are kept small enough for long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def hash_rank(ident: str, seed: int) -> Column:
    """A row's place in a random order fixed by its id, from 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(ident, F.lit(seed)), 1)


def hash_limit(wanted: int, rows: int) -> int:
    """The highest `hash_rank` of a sample of about ``wanted`` of ``rows`` rows; whole
    numbers, so the share of a table of any size is above 0."""
    return min(2**63 - 1, wanted * 2**63 // max(rows, 1))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def stage(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The rows of ``df``, written once to the shared folder, and their path."""
    spark = df.sparkSession
    path = staging_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later step reads."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(conf).delete(there, True)


def _fingerprint(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.bit_xor(mixed), F.sum(mixed.cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame, spent: list[str]) -> DataFrame:
    """Larger neighbours of each node move to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, path = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).withColumnRenamed("a", "b"), "least")
    spent.append(path)
    return edges.join(least, "b").select("a", F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, spent: list[str]) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest of them."""
    least, path = stage(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    spent.append(path)
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows ``node, component``.

    ``component`` is the smallest node reachable; only nodes with an edge to another
    node appear. Nodes may be of any ordered type. Rows with a null end and loops are
    ignored. Large-star and small-star alternate until the edges stop changing; each
    half step keeps at most as many edges as there were, neighbour minima are
    aggregated before they are shuffled, and every step is written to the shared
    folder, so a hub's edges are an ordinary skewed join against one small row.
    """
    spark = edges.sparkSession
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, path = stage(ordered, "edges")
    before = _fingerprint(current)
    while before[0]:
        spent = [path]
        mid, mid_path = stage(_large_star(current, spent), "edges")
        spent.append(mid_path)
        current, path = stage(_small_star(mid, spent), "edges")
        after = _fingerprint(current)
        remove(spark, *spent)
        if after == before:
            break
        before = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    memo = _words
    if len(memo) > MEMO_WORDS:
        memo.clear()
    found = [memo.get(w) for w in words]
    if None in found:
        hashed = xxhash.xxh3_64_intdigest
        for i, h in enumerate(found):
            if h is None:
                w = words[i]
                found[i] = memo[w] = hashed(w)
    return np.array(found, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64, so that every bit depends on every other."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words are one shingle."""
    size, width = len(words), len(_SHINGLE)
    if size == 0:
        return words
    if size < width:
        value = np.full(1, size, np.uint64)
        for i in range(size):
            value = mix(value * _MIX + words[i])
        return value
    total = np.zeros(size - width + 1, np.uint64)
    for i, factor in enumerate(_SHINGLE):
        total += mix(words[i : size - width + 1 + i] ^ factor) * factor
    return np.unique(mix(total))
