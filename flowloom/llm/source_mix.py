"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of the mix, at most ``limit`` times its own size. Every
document of the source is owed ``target / size of the source`` copies: a whole number of
copies, which it gets, and a fraction. Fractions are made whole in pairs: of two
documents, one takes words owed from the other until one of the two is owed none or
all of its words. Which way the words go is drawn so that the expected copies of both stay
what they were, and no word owed is lost, so a source's words stay at its target.

The pairs form a tree. Documents of a source are dealt to groups by a hash of their id;
a group folds its documents one after another into one that is still owed a fraction,
and those of all groups are dealt to groups again, until a source has few left. Groups
hold documents of like size (within a factor of two), and of each size some documents, 16
to 512, are held back from the tree. At the root of a source's tree one document is left; it is paired
with all those held back, taken together, and then each of them, by descending size, with
those after it. They are owed the same fraction, and go on sharing one, so this is the
same rule with a pool as partner: words move until the document or the pool is owed none
or all, expectations stay, and what is left for the last draw is one short document.

Every step is a DataFrame aggregate over groups of bounded size; a source that holds most
documents only has more groups. Rows that agree in id, source and size are counted before
they are dealt, and dealt one by one. Draws are hashes of ids and a seed: reruns agree,
whatever the partitioning.

Defined cases: null and wordless texts have size 0 and are taken 0 times. A null source is
a source of its own, the last in order; sources without words have target 0. Null and
repeated ids are ordinary rows. An empty table gives an empty result. Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import stage
from flowloom.operators.ranking import range_bucketed, ranked

# Fixed values of the mix
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
WORD = r"[^\x20\x09-\x0D]+"
# documents folded in one group, and left to the last fold of a source
GROUP = 64
LAST = 512
# documents of each size kept for the last fold
_HELD_BACK = 16
_UNIT = "struct<key: bigint, doc_id: {id}, size: bigint, owed: double>"


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, source_size)``, one row a source.

    Weights repeat over the sources in order of code points, null last. Shares above the
    limit are cut to it and their excess goes to the others by weight, until none is above.
    """
    ordered = range_bucketed(sizes.withColumn("_none", F.col("source").isNull()), ["_none", "source"])
    placed = ranked(ordered, [], ["_none", "source"], F.col("_range"), "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows, _ = stage(placed.select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * limit).alias("_most")), "sources")
    whole = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    # a source is at its limit from a certain ratio of words to weight on; the ratio only grows
    ratio = 0.0
    while True:
        full = F.col("_weight") * ratio >= F.col("_most")
        kept, left = rows.agg(
            F.sum(F.when(full, F.col("_most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight")))
        ).first()
        after = (whole - kept) / left if left else ratio
        if not after > ratio:
            break
        ratio = after
    target = F.least(F.col("_most").cast("double"), F.col("_weight") * ratio)
    return rows.select("source", "source_size", target.alias("target"))


def _draw(a: Column, b: Column, seed: int) -> Column:
    """Uniform number in [0, 1) that depends on the two documents and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), a, b), F.lit(2**53)) / F.lit(float(2**53))


def _fold(units: Column, kind: str, seed: int) -> Column:
    """Fold an array of units into ``(open, done)``: one unit still owed, the others decided.

    ``open`` and the next unit are owed ``a`` of ``s`` and ``b`` of ``t`` words. Either words
    move to ``open`` until it is owed all or the next none, or the other way.
    """
    unit, decided = _UNIT.format(id=kind), f"array<struct<doc_id: {kind}, size: bigint, copy: int>>"

    def paired(acc: Column, x: Column) -> Column:
        o = acc["open"]
        up = F.least(o["size"] - o["owed"], x["owed"])
        down = F.least(o["owed"], x["size"] - x["owed"])
        toward = (up + down == 0) | (_draw(o["key"], x["key"], seed) * (up + down) < down)
        moved = F.struct(o.alias("o"), x.alias("x"), up.alias("up"), down.alias("down"), toward.alias("toward"))

        def settled(m: Column) -> Column:
            o, x = m["o"], m["x"]
            # toward the open one: it is full (the next goes on with the rest), or the next is owed none
            full = m["toward"] & (o["size"] - o["owed"] <= x["owed"])
            empty = ~m["toward"] & (o["owed"] <= x["size"] - x["owed"])
            ends = full | empty
            goes = F.when(ends, x).otherwise(o)
            owed = (
                F.when(full, x["owed"] - m["up"])
                .when(empty, x["owed"] + m["down"])
                .when(m["toward"], o["owed"] + m["up"])
                .otherwise(o["owed"] - m["down"])
            )
            stops = F.when(ends, o).otherwise(x)
            copy = F.when(full, 1).when(empty, 0).when(m["toward"], 0).otherwise(1)
            open_ = F.struct(goes["key"].alias("key"), goes["doc_id"].alias("doc_id"), goes["size"].alias("size"), owed.alias("owed"))
            done = F.struct(stops["doc_id"].alias("doc_id"), stops["size"].alias("size"), copy.alias("copy"))
            return F.struct(
                open_.cast(unit).alias("open"), F.concat(acc["done"], F.array(done)).cast(decided).alias("done")
            )

        # a one-element array names the pair, so that it is worked out once
        return F.element_at(F.transform(F.array(moved), settled), 1)

    first = F.struct(F.element_at(units, 1).cast(unit).alias("open"), F.array().cast(decided).alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), first, paired)


def _fold_pool(units: Column, kind: str, seed: int) -> Column:
    """Words owed to each of ``units`` once every one has been paired with the pool of those after it.

    Units marked ``own`` come first and are owed words of their own; the others share the
    pool's words in proportion to their size.
    """
    decided = f"array<struct<key: bigint, doc_id: {kind}, size: bigint, owed: double>>"

    def taken_out(acc: Column, x: Column) -> Column:
        size = x["size"].cast("double")
        left = F.when(x["own"], acc["total"]).otherwise(acc["total"] - size)
        shared = F.when(acc["total"] > 0, F.least(F.lit(1.0), acc["owed"] / acc["total"])).otherwise(0.0)
        owed = F.when(x["own"], x["owed"]).otherwise(shared * size)
        pool = F.when(x["own"], acc["owed"]).otherwise(shared * left)
        return F.struct(
            acc.alias("acc"), x.alias("x"), size.alias("size"), left.alias("total"), owed.alias("a"), pool.alias("b")
        )

    def paired(m: Column) -> Column:
        x, size, total, a, b = m["x"], m["size"], m["total"], m["a"], m["b"]
        up, down = F.least(size - a, b), F.least(a, total - b)
        still = up + down <= 0
        toward = _draw(x["key"], F.lit("pool"), seed) * (up + down) < down
        owed = (
            F.when(still, a)
            .when(toward, F.when(size - a <= b, size).otherwise(a + up))
            .otherwise(F.when(a <= total - b, F.lit(0.0)).otherwise(a - down))
        )
        pool = (
            F.when(still, b)
            .when(toward, F.when(b <= size - a, F.lit(0.0)).otherwise(b - up))
            .otherwise(F.when(total - b <= a, total).otherwise(b + down))
        )
        one = F.struct(x["key"].alias("key"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), owed.alias("owed"))
        return F.struct(
            pool.cast("double").alias("owed"),
            total.cast("double").alias("total"),
            F.concat(m["acc"]["done"], F.array(one)).cast(decided).alias("done"),
        )

    def pooled(name: str) -> Column:
        shares = F.transform(units, lambda u: F.when(u["own"], 0.0).otherwise(u[name].cast("double")))
        return F.aggregate(shares, F.lit(0.0), lambda total, v: total + v)

    first = F.struct(pooled("owed").alias("owed"), pooled("size").alias("total"), F.array().cast(decided).alias("done"))
    return F.aggregate(units, first, lambda acc, x: F.element_at(F.transform(F.array(taken_out(acc, x)), paired), 1))["done"]


_SOURCE = ["source_no", "source_size", "target", "base"]


def _groups(units: DataFrame, group: Sequence[str], order: Sequence[str], kind: str, seed: int) -> DataFrame:
    """One fold per group of ``units``, in order of the columns named."""
    rest = [c for c in ("key", "doc_id", "size", "owed") if c not in order]
    members = F.sort_array(F.collect_list(F.struct(*order, *rest)))
    arrays = units.groupBy(*group).agg(members.alias("units"))
    named = F.transform("units", lambda u: F.struct(*[u[c].alias(c) for c in ("key", "doc_id", "size", "owed")]))
    return arrays.select(*group, _fold(named, kind, seed).alias("fold"))


def _settled(folds: DataFrame) -> DataFrame:
    return folds.select(*_SOURCE, F.explode("fold.done").alias("d")).select(*_SOURCE, "d.doc_id", "d.size", "d.copy")


def round_copies(units: DataFrame, seed: int, group_rows: int = GROUP, last_rows: int = LAST) -> DataFrame:
    """Pivotal rounding of ``units`` (source columns, ``key, doc_id, size, owed``) per source.

    Returns every unit once with ``copy`` 0 or 1.
    """
    kind = units.schema["doc_id"].dataType.simpleString()
    scale = F.length(F.bin("size"))
    at_scale = units.groupBy("source_no", scale.alias("scale")).agg(F.count("*").alias("n"))
    # of each size as many as make up for two of the source's longest documents, within bounds
    longest = F.max("scale").over(Window.partitionBy("source_no"))
    make_up = F.least(F.lit(last_rows), F.greatest(F.lit(_HELD_BACK), F.pow(F.lit(2.0), longest - F.col("scale") + 1)))
    at_scale, _ = stage(at_scale.withColumn("_keep", make_up), "scales")
    rows = units.withColumn("scale", scale).join(at_scale, ["source_no", "scale"])
    # a number in [0, 1) per unit and level deals it to a group
    place = F.pmod(F.xxhash64(F.lit(seed), F.lit("deal"), "key"), F.lit(2**31)) / F.lit(float(2**31))
    rows = rows.withColumn("_held", place * F.col("n") < F.col("_keep"))
    rows = rows.withColumn("_group", F.floor(place * F.ceil(F.col("n") / group_rows)))
    rows, _ = stage(rows.drop("n", "_keep"), "units")
    level, done = rows.where("not _held"), []
    while True:
        folds, _ = stage(_groups(level, [*_SOURCE, "scale", "_group"], ["key"], kind, seed), "folds")
        done.append(_settled(folds))
        left = folds.select(*_SOURCE, "scale", "_group", "fold.open.*")
        most = left.groupBy("source_no").count().agg(F.max("count")).first()[0] or 0
        if most <= last_rows:
            break
        level = left.withColumn("_group", F.floor(F.col("_group") / group_rows))
    roots, _ = stage(_groups(left.withColumn("_descending", -F.col("size")), _SOURCE, ["_descending", "key"], kind, seed), "roots")
    done.append(_settled(roots))
    own = roots.select(*_SOURCE, "fold.open.*").withColumn("own", F.lit(True))
    pool = rows.where("_held").select(*own.columns[:-1]).withColumn("own", F.lit(False))
    members = F.struct((~F.col("own")).alias("pooled"), (-F.col("size")).alias("down"), "key", "doc_id", "size", "owed", "own")
    last = own.unionByName(pool).groupBy(*_SOURCE).agg(F.sort_array(F.collect_list(members)).alias("units"))
    decided = last.select(*_SOURCE, F.explode(_fold_pool(F.col("units"), kind, seed)).alias("d"))
    # one document of a source at most is neither owed none nor all of its words
    lucky = _draw(F.col("d.key"), F.lit("end"), seed) * F.col("d.size") < F.col("d.owed")
    done.append(decided.select(*_SOURCE, "d.doc_id", "d.size", lucky.cast("int").alias("copy")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    sized, _ = stage(sized, "sizes")
    totals, _ = stage(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), "source-sizes")
    targets = source_targets(totals, weights, share, limit)
    owed = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.select(
        F.col("source").alias("_source"), F.xxhash64(F.col("source").isNull(), "source").alias("source_no"),
        "source_size", "target", F.floor(owed).alias("base"), (owed - F.floor(owed)).alias("fraction"),
    )
    targets, _ = stage(targets, "targets")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    whole = rows.where("size = 0 or fraction = 0")
    units = rows.where("size > 0 and fraction > 0").select(
        *_SOURCE,
        F.xxhash64(F.lit(seed), "source_no", F.col("doc_id").isNull(), "doc_id", "size", "copy_no").alias("key"),
        "doc_id",
        "size",
        (F.col("fraction") * F.col("size")).alias("owed"),
    )
    rounded = round_copies(units, seed)
    columns = ["doc_id", "size", "source_size", "target"]
    return whole.select(*columns, (F.col("base") * F.col("size")).alias("taken")).unionByName(
        rounded.select(*columns, ((F.col("base") + F.col("copy")) * F.col("size")).alias("taken"))
    )
