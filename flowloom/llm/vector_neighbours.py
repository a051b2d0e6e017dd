"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned into the axes of the second-moment matrix,
largest first, which leaves every cosine as it is. Within a label the distinct vectors
are cut into blocks along the first axis, hot stretches of it being dealt out evenly;
two blocks further apart on that axis than the threshold allows are never compared.
A tile compares two blocks: it accumulates the leading axes first, bounds what the rest
could add by the product of the suffix norms, and stops for all pairs, or for the rows
and columns left, once the threshold is out of reach.

A tile never emits pairs. It returns, per vector, how many vectors it links to and the
smallest vector of its component inside the tile; sums and large-star / small-star over
those forests give exact link counts and components. Equal vectors are one vector with
a count, so a group of copies costs what one of them costs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and vectors without a label, link with nothing, as do vectors of different length. A row
without an id links with nothing, has no component and is kept. Repeated ids are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import components, remove, stage

THRESHOLD = 0.93
BLOCK = 4096
_STRIPE = 512
_STEPS = (8, 16, 32)
_EPS = 1e-12


def _unit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        units, digests, widths = [], [], []
        for ident, vector, label in zip(batch["id"], batch["vector"], batch["label"], strict=True):
            unit = digest = None
            if vector is not None and len(vector) and not pd.isna(label) and not pd.isna(ident):
                x = np.asarray(vector, dtype=np.float64)
                if np.isfinite(x).all() and x.any():
                    scaled = x / np.abs(x).max()
                    unit = (scaled / np.sqrt(scaled @ scaled)).tobytes()
                    digest = hashlib.md5(f"{label}:{len(x)}:".encode() + (x + 0.0).tobytes()).digest()
            units.append(unit)
            digests.append(digest)
            widths.append(0 if unit is None else len(unit) // 8)
        yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "width": widths, "digest": digests, "unit": units})


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for width, rows in batch.groupby("width"):
            x = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(-1, width)
            sums[width] = sums.get(width, 0) + x.T @ x
    for width, total in sums.items():
        yield pd.DataFrame({"width": np.int32(width), "cell": np.arange(width * width), "value": total.ravel()})


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Axes per vector length, from all rows; only width * width sums reach the driver."""
    sums = reps.select("width", "unit").mapInPandas(_moments, "width int, cell long, value double")
    cells = sums.groupBy("width", "cell").agg(F.sum("value").alias("value")).collect()
    axes = {}
    for width in sorted({row["width"] for row in cells}):
        matrix = np.zeros(width * width)
        for row in cells:
            if row["width"] == width:
                matrix[row["cell"]] = row["value"]
        matrix = matrix.reshape(width, width)
        axes[width] = np.ascontiguousarray(np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1])
    return axes


def _turned(axes: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, rows in batch.groupby("width"):
                x = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(-1, width) @ axes[width]
                yield pd.DataFrame(
                    {
                        "label": rows["label"].to_numpy(),
                        "width": np.int32(width),
                        "rep": rows["rep"].to_numpy(),
                        "copies": rows["copies"].to_numpy(),
                        "lead": x[:, 0],
                        "vector": [row.tobytes() for row in x],
                    }
                )

    return run


def _merge(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the sets of linked positions; every label ends as the smallest position."""
    while True:
        a, b = labels[left], labels[right]
        open_ = a != b
        if not open_.any():
            return
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with x[i] . y[j] >= threshold; axes are in order of weight."""
    width = x.shape[1]
    rows, cols = np.arange(len(x)), np.arange(len(y))
    product, done = 0.0, 0
    for step in (*(s for s in _STEPS if s < width), width):
        product = product + x[rows, done:step] @ y[cols, done:step].T
        done = step
        if done == width:
            break
        rest = np.sqrt((x[rows, done:] ** 2).sum(1))[:, None] * np.sqrt((y[cols, done:] ** 2).sum(1))[None, :]
        alive = product + rest >= threshold - _EPS
        keep_rows, keep_cols = alive.any(1), alive.any(0)
        if not keep_rows.any():
            return rows[:0], cols[:0]
        i, j = np.nonzero(alive)
        if len(i) < 0.02 * alive.size:  # few left: finish them one by one
            dots = product[i, j] + np.einsum("ij,ij->i", x[rows[i], done:], y[cols[j], done:])
            near = dots >= threshold
            return rows[i[near]], cols[j[near]]
        product = product[np.ix_(keep_rows, keep_cols)]
        rows, cols = rows[keep_rows], cols[keep_cols]
    i, j = np.nonzero(product >= threshold)
    return rows[i], cols[j]


def _tile(threshold: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["side", "rep"], kind="stable")
        width = int(part["width"].iloc[0])
        x = np.frombuffer(b"".join(part["vector"]), np.float64).reshape(-1, width)
        copies, reps = part["copies"].to_numpy(), part["rep"].to_numpy()
        split = int((part["side"] == 0).sum())
        within = split == len(part)
        other = x if within else x[split:]
        shift = 0 if within else split
        links, labels = np.zeros(len(part), np.int64), np.arange(len(part))
        for start in range(0, split, _STRIPE):
            i, j = linked_pairs(x[start : min(start + _STRIPE, split)], other, threshold)
            i, j = i + start, j + shift
            if within:
                ahead = i < j
                i, j = i[ahead], j[ahead]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            _merge(labels, i, j)
        smallest = pd.Series(reps).groupby(labels).transform("min").to_numpy()
        some = links > 0
        return pd.DataFrame({"rep": reps[some], "links": links[some], "root": smallest[some]})

    return run


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, block: int = BLOCK,
) -> DataFrame:
    """``<id>, n_links, component_id, kept`` for every row; see the module text."""
    spark = rows.sparkSession
    source = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label")
    )
    keyed, keyed_path = stage(source.mapInPandas(_unit_rows, "id long, label string, width int, digest binary, unit binary"), "vectors")
    known = keyed.where("digest is not null")
    reps, reps_path = stage(
        known.groupBy("digest").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"),
            F.any_value("width").alias("width"), F.any_value("unit").alias("unit"),
        ),
        "distinct",
    )
    turned, turned_path = stage(
        reps.mapInPandas(_turned(principal_axes(reps)), "label string, width int, rep long, copies long, lead double, vector binary"), "turned"
    )
    shelf = F.floor(F.col("lead") * 100).alias("shelf")
    ahead = Window.partitionBy("label", "width").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    shelves, shelves_path = stage(
        turned.groupBy("label", "width", shelf)
        .agg(F.count("*").alias("filled"))
        .withColumn("before", F.coalesce(F.sum("filled").over(ahead), F.lit(0))),
        "shelves",
    )
    place = F.floor((F.col("before") + F.pmod(F.xxhash64("rep"), F.col("filled"))) / block)
    placed, placed_path = stage(
        turned.withColumn("shelf", F.floor(F.col("lead") * 100))
        .join(shelves, ["label", "width", "shelf"])
        .select("label", "width", "rep", "copies", "lead", "vector", place.alias("block")),
        "blocks",
    )
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    spans, spans_path = stage(placed.groupBy("label", "width", "block").agg(F.min("lead").alias("low"), F.max("lead").alias("high")), "spans")
    left, right = spans.alias("l"), spans.alias("r")
    tiles = left.join(
        right,
        (F.col("l.label") == F.col("r.label")) & (F.col("l.width") == F.col("r.width")) & (F.col("l.block") <= F.col("r.block"))
        & (F.col("r.low") - F.col("l.high") <= reach) & (F.col("l.low") - F.col("r.high") <= reach),
    ).select("l.label", "l.width", F.col("l.block").alias("i"), F.col("r.block").alias("j"))
    tiles, tiles_path = stage(tiles, "tiles")
    columns = ["label", "width", "i", "j", "rep", "copies", "vector"]
    first = placed.withColumnRenamed("block", "i").join(tiles, ["label", "width", "i"]).select(*columns, F.lit(0).alias("side"))
    second = placed.withColumnRenamed("block", "j").join(tiles.where("i <> j"), ["label", "width", "j"]).select(*columns, F.lit(1).alias("side"))
    found, found_path = stage(
        first.unionByName(second).groupBy("label", "width", "i", "j").applyInPandas(_tile(threshold), "rep long, links long, root long"), "links"
    )
    groups, groups_path = stage(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))), "groups")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_digest, _ = stage(
        reps.select("digest", "rep", "copies")
        .join(linked, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")),
        "classes",
    )
    ids, _ = stage(keyed.select("id", "digest"), "members")
    remove(spark, keyed_path, reps_path, turned_path, shelves_path, placed_path, spans_path, tiles_path, found_path, groups_path)
    component = F.coalesce("component", "id")
    return ids.join(per_digest, "digest", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
