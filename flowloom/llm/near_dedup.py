"""Near-duplicate documents: MinHash, banding, verification, connected components.

A document is the set of its distinct 5-word shingles (fewer words: one shingle, the
whole sequence; no words: an empty set that links with nothing). Equal sets are one
*class*, named by 64 bits of a digest of the set, so a group of exact copies costs what
one of them costs.

1. ``ROWS * BANDS`` multiply-shift hashes give one minimum each; ``ROWS`` neighbouring
   minima are hashed to a band key. Two sets at similarity 0.75 miss every band with
   probability (1 - 0.75**5)**40 = 2e-5, at 0.8 with 1e-7.
2. In each band bucket every class is compared with the bucket's smallest class only
   (its centre): signatures first, then the full sets, 100 * intersection >= 75 * union.
   Confirmed links are joined to components.
3. What is left are classes that share a bucket but no component. They are not written
   out as pairs: a component of several classes is compared as a whole, block by block,
   with everything outside it that met it in a bucket; classes that stand alone are
   compared by signature in tiles of their bucket, and only pairs whose signatures agree
   go on to the full sets. So every pair of a bucket is either in one component or has
   been compared; none is capped or sampled.
4. Large-star / small-star over all links gives the components.

Sets and signatures travel only for classes that share a bucket with another one, and are
computed again from the texts. Their ids are broadcast while they are at most
``BROADCAST_IDS``; beyond that the same join is shuffled.

Defined cases: null or empty text has no shingles; rows that repeat an id are one
document for linking and stay separate rows; a row without an id is never linked, has
no component and is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import components, frugal, mix, remove, shingle_hashes, stage, whole_texts, word_hashes

ROWS, BANDS = 5, 40
SIMILARITY = 75  # per cent
# agreeing bytes of two signatures at similarity 0.75: mean 150, deviation 6.1; five
# deviations below the mean lose one true link in a million
LEAST_EQUAL = 119
BLOCK = 256  # classes a side of a comparison of sets
TILE = 1024  # classes a side of a comparison of signatures
BROADCAST_IDS = 4_000_000
_CHUNK = 4096

_rng = np.random.Generator(np.random.PCG64(20240607))
_FACTOR = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash over a set: uint32, ``ROWS * BANDS`` of them."""
    least = np.full(ROWS * BANDS, 2**32 - 1, np.uint64)
    for start in range(0, len(shingles), _CHUNK):
        values = (_FACTOR[:, None] * shingles[None, start : start + _CHUNK] + _SHIFT[:, None]) >> np.uint64(32)
        np.minimum(least, values.min(axis=1), out=least)
    return least.astype(np.uint32)


def band_keys(minima: np.ndarray) -> np.ndarray:
    keys = _SALT.copy()
    for column in minima.astype(np.uint64).reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes, classes, bands = [], [], []
        for text in batch["text"]:
            shingles = shingle_hashes(word_hashes(text))
            sizes.append(len(shingles))
            classes.append(class_of(shingles))
            bands.append(band_keys(signature(shingles)) if len(shingles) else None)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n": sizes, "node": pd.array(classes, "Int64"), "bands": bands})


def class_of(shingles: np.ndarray) -> int | None:
    """64 bits that stand for a set; none for the empty set."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        nodes, sets, signatures = [], [], []
        for node, text in zip(batch["node"], batch["text"], strict=True):
            shingles = shingle_hashes(word_hashes(text))
            if class_of(shingles) == node:  # rows may share an id and differ in text
                nodes.append(node)
                sets.append(shingles.tobytes())
                signatures.append(signature(shingles).astype(np.uint8).tobytes())
        yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "shingles": sets, "signature": signatures})


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by ``keys``; a group must fit in memory."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]).any(1)]))
        bounds = [*starts.tolist(), len(batch)]
        for at, end in zip(bounds[:-1], bounds[1:], strict=True):
            part = batch.iloc[at:end]
            if held and (held[-1][keys].iloc[-1].to_numpy() != values[at]).any():
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def _compared(keys: list[str], every: bool):
    """Hosts (side 0) against guests (side 1) of a group, on signatures and full sets.

    ``every``: a row for each pair; else for each guest one host it is linked to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, keys):
            side = group["side"].to_numpy()
            hosts, guests = group[side == 0], group[side == 1]
            if not len(hosts) or not len(guests):
                continue
            nodes = guests["node"].to_numpy()
            sizes = np.array([len(x) // 8 for x in guests["shingles"]])
            signatures = np.frombuffer(b"".join(guests["signature"]), np.uint8).reshape(len(guests), -1)
            owner = np.repeat(np.arange(len(guests)), sizes)
            pool = np.frombuffer(b"".join(guests["shingles"]), np.uint64)
            order = np.argsort(pool)
            pool, owner = pool[order], owner[order]
            linked = np.zeros(len(guests), bool)
            out = []
            for node, shingles, own in zip(hosts["node"], hosts["shingles"], hosts["signature"], strict=True):
                alike = (signatures == np.frombuffer(own, np.uint8)).sum(1) >= LEAST_EQUAL
                if not every:
                    alike &= ~linked
                if not alike.any() and not every:
                    continue
                mine = np.frombuffer(shingles, np.uint64)
                low = np.searchsorted(pool, mine, side="left")
                high = np.searchsorted(pool, mine, side="right")
                hit = high > low
                spans = high[hit] - low[hit]
                places = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
                inter = np.bincount(owner[places], minlength=len(guests))
                total = sizes + len(mine) - inter
                link = alike & (100 * inter >= SIMILARITY * total)
                linked |= link
                chosen = np.ones(len(guests), bool) if every else link
                out.append(pd.DataFrame({"x": node, "y": nodes[chosen], "linked": link[chosen]}))
            if out:
                yield pd.concat(out)

    return run


def _alike(keys: list[str]):
    """Pairs of a tile whose signatures agree; rows have side 0, side 1 or, on the diagonal, 0 only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, keys):
            side, nodes = group["side"].to_numpy(), group["node"].to_numpy()
            marks = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1)
            first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            same_tile = group[keys[-2]].iloc[0] == group[keys[-1]].iloc[0]
            x, y = [], []
            for k, i in enumerate(first):
                others = first[k + 1 :] if same_tile else second
                near = others[(marks[others] == marks[i]).sum(1) >= LEAST_EQUAL]
                x.append(np.full(len(near), nodes[i]))
                y.append(nodes[near])
            if x:
                yield pd.DataFrame({"x": np.concatenate(x).astype(np.int64), "y": np.concatenate(y).astype(np.int64)})

    return run


def _grouped(rows: DataFrame, keys: list[str], fn, kinds: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(fn, kinds)


def _compare_pairs(pairs: DataFrame, sets: DataFrame, every: bool) -> DataFrame:
    """``pairs(x, y)`` as hosts x, each with blocks of its guests y: ``x, y, linked``."""
    many = pairs.groupBy("x").agg(F.count("*").alias("_many"))
    dealt = pairs.join(many, "x").withColumn("block", F.pmod(F.xxhash64("y"), F.ceil(F.col("_many") / BLOCK)))
    guests = dealt.select("x", "block", F.col("y").alias("node"), F.lit(1).alias("side"))
    hosts = dealt.select("x", "block").distinct().select("x", "block", F.col("x").alias("node"), F.lit(0).alias("side"))
    rows = hosts.unionByName(guests).join(sets, "node")
    return _grouped(rows, ["x", "block"], _compared(["x", "block"], every), "x long, y long, linked boolean")


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _outside_components(placed: DataFrame, sizes: DataFrame, sets: DataFrame, spent: list[str]) -> DataFrame:
    """Links between components of several classes and what met them in a bucket."""
    own = placed.select("bucket", "own", "members").distinct()
    large = own.where("members > 1").select("bucket", F.col("own").alias("host"), F.col("members").alias("_hosts"))
    met = own.join(large, "bucket").where(
        "own <> host and (members < _hosts or (members = _hosts and own > host))"
    )  # the smaller one is the guest
    met, path = stage(met.select("host", F.col("own").alias("guest"), F.col("_hosts"), F.col("members").alias("_guests")).distinct(), "met")
    spent.append(path)
    totals = met.groupBy("host").agg(F.sum("_guests").alias("_all"), F.max("_hosts").alias("_hosts"))
    hosts = totals.select("host", F.ceil(F.col("_hosts") / BLOCK).alias("rows"), F.ceil(F.col("_all") / BLOCK).alias("cols"))
    members = sizes.select("node", "own")
    left = (
        hosts.join(members.withColumnRenamed("own", "host"), "host")
        .withColumn("i", F.pmod(F.xxhash64("node"), F.col("rows")))
        .select("host", "i", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), "node", F.lit(0).alias("side"))
    )
    right = (
        met.select("host", F.col("guest").alias("own")).join(members, "own").join(hosts, "host")
        .withColumn("j", F.pmod(F.xxhash64("node"), F.col("cols")))
        .select("host", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), "j", "node", F.lit(1).alias("side"))
    )
    keys = ["host", "i", "j"]
    rows = left.select(*keys, "node", "side").unionByName(right.select(*keys, "node", "side")).join(sets, "node")
    return _grouped(rows, keys, _compared(keys, False), "x long, y long, linked boolean")


def _lone_pairs(placed: DataFrame, sets: DataFrame, spent: list[str]) -> DataFrame:
    """Pairs of single classes of a bucket whose signatures agree: ``x, y``."""
    lone = placed.where("members = 1").select("bucket", "node")
    filled = lone.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    filled, path = stage(filled.select("bucket", F.ceil(F.col("_n") / TILE).alias("tiles")), "filled")
    spent.append(path)
    dealt = lone.join(filled, "bucket").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    spread = dealt.select("bucket", "node", "tile", every).select(
        "bucket", "node", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side")
    )
    keys = ["bucket", "i", "j"]
    rows = spread.join(sets.select("node", "signature"), "node")
    found = _grouped(rows, keys, _alike(keys), "x long, y long")
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_shingles, component_id, kept`` for every row; see the module text."""
    spark, spent = docs.sparkSession, []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        staged, path = stage(df, tag)
        spent.append(path)
        return staged

    source = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profiles = kept(source.mapInPandas(frugal(_profiles), "doc_id long, n long, node long, bands array<long>"), "profiles")
    known = profiles.where("node is not null and doc_id is not null")
    entries = known.select("node", F.explode("bands").alias("bucket"))
    ends = entries.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("_last"))
    centres = kept(ends.where("centre <> _last").select("bucket", "centre"), "centres")
    members = kept(entries.join(centres, "bucket").select("bucket", "centre", "node").distinct(), "members")
    stars = kept(members.where("node <> centre").select(F.col("centre").alias("x"), F.col("node").alias("y")).distinct(), "pairs")

    classes = kept(known.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "classes")
    together = kept(members.select("node").distinct(), "together")
    wanted = kept(classes.join(together, "node"), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = kept(source.join(wanted, "doc_id").select("node", "text").mapInPandas(frugal(_sets), "node long, shingles binary, signature binary"), "sets")
    sets = kept(sets.dropDuplicates(["node"]), "distinct")

    near = kept(_links(_compare_pairs(stars, sets, False)), "near")
    first = kept(components(near), "first")
    owned = together.join(first.withColumnRenamed("component", "own"), "node", "left").select("node", F.coalesce("own", "node").alias("own"))
    sizes = kept(owned.join(owned.groupBy("own").agg(F.count("*").alias("members")), "own"), "owners")
    placed = members.select("bucket", "node").join(sizes, "node")
    mixed = placed.groupBy("bucket").agg(F.min("own").alias("_a"), F.max("own").alias("_b")).where("_a <> _b").select("bucket")
    placed = kept(placed.join(mixed, "bucket").select("bucket", "node", "own", "members"), "placed")
    large = kept(_links(_outside_components(placed, sizes, sets, spent)), "large")
    lone = kept(_lone_pairs(placed, sets, spent), "lone")
    small = kept(_links(_compare_pairs(lone, sets, False)), "small")
    grown = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(large).unionByName(small)
    final = kept(components(grown), "components")

    # a component is named by its smallest document id
    grouped = classes.join(final, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    names = grouped.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    named, _ = stage(grouped.join(names, "component").select("node", "smallest"), "named")
    rows, _ = stage(profiles.select("doc_id", "n", "node"), "rows")
    remove(spark, *spent)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    return rows.join(named, "node", "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
