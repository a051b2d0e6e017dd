"""Query registration and test inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.catalog.views import VIEWS, inline
from flowloom.operators import labels as L
from flowloom.operators.flows import flow_id, flow_packets
from flowloom.profiles import UNIFIED, FlowProfile
from flowloom.session import configure, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOTERS_PER_TASK = 1000


@dataclass(frozen=True)
class Inputs:
    """Tables of one scale-factor folder and what Spark derives from them."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """A derived view by its shared SQL text; used where that SQL scales."""
        body = VIEWS[name]
        for dependency in body.views:
            self.view(dependency).createOrReplaceTempView(dependency)
        for table in body.tables:
            self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(body.sql)

    def packets(self) -> DataFrame:
        rows = self.view("packets").withColumnRenamed("pkt_id", "pkt_no")
        return rows.withColumn("ts", F.col("ts").cast("timestamp"))

    def keyed(self, profile: FlowProfile = UNIFIED) -> DataFrame:
        return flow_packets(self.packets(), profile)

    def captures(self) -> DataFrame:
        """One row per capture, staged so that joins know how small it is."""
        return staged(self.view("captures"), "captures")

    def samples(self) -> DataFrame:
        rows = self.table("documents").select(
            F.col("doc_id").alias("sample_id"),
            F.concat("lang", F.lit("/"), "source").alias("label"),
            "n_chars",
        )
        return L.encode_labels(rows)

    def features(self) -> DataFrame:
        return self.view("features")

    def predictions(self) -> DataFrame:
        return self.view("predictions")

    def votes(self) -> DataFrame:
        """Ten trees, two classes each, generated per embedding."""
        trees = self.table("embeddings").select(
            F.col("vec_id").alias("sample_id"),
            "label",
            F.explode(F.sequence(F.lit(0), F.lit(9))).alias("tree"),
        )
        first = (F.col("label") + (F.col("sample_id") + F.col("tree")) % 2) % 10
        step = ((F.col("sample_id") * 7 + F.col("tree") * 3) % 50).cast("double")
        weighted = trees.withColumn("_c", first).withColumn("_p", F.lit(0.25) + step / 100)
        sides = weighted.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1))))
        return sides.select(
            "sample_id",
            "tree",
            ((F.col("_c") + F.col("_k")) % 10).cast("bigint").alias("class_id"),
            F.when(F.col("_k") == 0, F.col("_p")).otherwise(1 - F.col("_p")).alias("prob"),
        )

    def many_votes(self) -> DataFrame:
        """A hundred trees, each with a vector of a thousand probabilities, generated per supplier.

        A supplier stands for 800 KB of vectors, so suppliers are dealt to tasks by their number.
        """
        suppliers = self.table("supplier").select(F.col("s_suppkey").alias("sample_id"))
        tasks = max(4 * self.spark.sparkContext.defaultParallelism, -(-suppliers.count() // VOTERS_PER_TASK))
        trees = suppliers.repartition(tasks).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(99))))
        first = F.pmod(F.col("sample_id") * 17 + F.pmod(F.col("sample_id") + F.col("tree"), F.lit(3)), F.lit(1000))
        step = F.pmod(F.col("sample_id") * 7 + F.col("tree") * 3, F.lit(50)).cast("double")
        sides = trees.withColumn("_a", first).withColumn("_p", F.lit(0.25) + step / 100)
        sides = sides.withColumn("_b", F.pmod(F.col("_a") + 1 + F.col("tree") % 2, F.lit(1000)))
        # two entries between zeros; a vector of a null id is all zeros
        vector = F.expr(
            """CASE WHEN _a IS NULL THEN array_repeat(0D, 1000) ELSE concat(
 array_repeat(0D, CAST(least(_a, _b) AS INT)), array(CASE WHEN _a < _b THEN _p ELSE 1 - _p END),
 array_repeat(0D, CAST(abs(_a - _b) - 1 AS INT)), array(CASE WHEN _a < _b THEN 1 - _p ELSE _p END),
 array_repeat(0D, CAST(999 - greatest(_a, _b) AS INT))) END"""
        )
        return sides.select("sample_id", "tree", vector.alias("probabilities"))

    def history(self) -> DataFrame:
        return self.view("history")

    def corpus(self, name: str) -> DataFrame:
        return self.view(f"corpus_{name}")

    def label_map(self, name: str) -> DataFrame:
        return self.view(f"label_map_{name}")


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(inputs)`` under ``name``; ``oracle`` may use the listed views."""

    def register(fn):
        def run(spark: SparkSession, root: str) -> DataFrame:
            configure(spark)
            return fn(Inputs(spark, root))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = inline(oracle, views)
        return fn

    return register


def flow_key_id() -> F.Column:
    return flow_id().alias("flow_id")


def r6(column):
    """Six decimals, with no negative zero."""
    return F.round(column, 6) + F.lit(0.0)


def big(*columns: str):
    return [F.col(c).cast("bigint").alias(c) for c in columns]
