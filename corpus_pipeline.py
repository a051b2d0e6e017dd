"""Corpus pipeline: from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``docs``. ``run`` writes every stage to the shared folder and reads it again.

Decisions are taken for rows, which are told by id and text: of rows that share an id, or
have none, a near duplicate or contaminated one goes and the others stay. Of rows that
repeat an id with equal text one stays. Empty and null texts have no language and go first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import stage, table
from flowloom.llm.decontamination import contaminated
from flowloom.llm.language_id import has_language, learn_languages
from flowloom.llm.near_dedup import near_duplicates
from flowloom.llm.packing import pack_documents
from flowloom.llm.quality import fit_quality, is_good

# keys of removed rows are broadcast up to this many; more are joined by a shuffle
BROADCAST_IDS = 4_000_000


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``_key`` is not among ``keys`` (staged)."""
    if keys.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return docs.join(keys, "_key", "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; text without letters or language goes."""
    return docs.where(has_language(learn_languages(docs))("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as good."""
    return docs.where(is_good(fit_quality(docs, table(spark, sf_dir, "labels")))("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Rows without an id of their own are named by a hash of id and text, above all ids.
    """
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1 or doc_id is null")
    shared, _ = stage(counts.select(F.col("doc_id").alias("_shared"), F.lit(True).alias("_odd")), "shared-ids")
    if shared.isEmpty():
        rows = docs.withColumn("_key", F.col("doc_id")).withColumn("_odd", F.lit(None).cast("boolean"))
    else:
        named = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"), 2) + F.lit(2**62)
        rows = docs.join(shared, F.col("doc_id").eqNullSafe(F.col("_shared")), "left").drop("_shared")
        rows = rows.withColumn("_key", F.when(F.col("_odd"), named).otherwise(F.col("doc_id")))
    found = near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"))
    removed, _ = stage(found.where("not kept").select(F.col("doc_id").alias("_key")).distinct(), "removed")
    left = _without(rows, removed)
    if not shared.isEmpty():
        left = left.where("_odd is null").unionByName(left.where("_odd").dropDuplicates(["doc_id", "text"]))
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    rows = docs.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = contaminated(rows.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit, _ = stage(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return _without(rows, hit).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in the packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
# a network, tokenizers and MinHash have no SQL form; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs, _ = stage(step(spark, docs, sf_dir), name)
    return docs
