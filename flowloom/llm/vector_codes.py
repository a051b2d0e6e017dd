"""Compression of vectors to codes by equal-average search.

Components become integers ``floor(scale * x)`` and a vector is cut into equal parts, each
with a codebook of its own. To find the nearest entry of a part, the entries are sorted by
the sum of their components. The search starts at the part's own sum and moves outward,
always to the side with the smaller gap of sums: since ``gap**2 / dimension`` is a lower
bound of the squared distance, it ends once that bound strictly exceeds the best distance.
The bound being strict, every entry at the best distance is seen and ties go to the lower
index. Distances, sums and means are whole numbers, so results do not depend on the order
or partitioning of the rows.

A round adds up the parts of every entry inside each task, and Spark adds the tasks'
sums. Only codebooks (entries times dimension) and their sums reach the driver.

Defined cases: rows whose vector is null or holds null or non-finite components are
dropped. Of the others, empty vectors, vectors whose length is no multiple of the number
of parts or differs from that of the first usable row (by id, then by vector), and vectors
with a component too large for exact 64-bit distances (``largest_component``) belong to no
codebook: their code and error are null and they take no part in codebooks. Rows that
repeat an id are coded one by one; null ids come last in the order that starts the
codebooks. Fewer usable rows than entries give shorter codebooks; an empty table gives an
empty result. The error of a label without any coded row is null. Further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stage, whole_texts

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# rows searched together in a task
_CHUNK = 16_384
# larger than any sum of a part; its square fits 64 bits
_BEYOND = 2**31


def largest_component(width: int, parts: int = PARTS) -> int:
    """Bound below which no squared sum, distance or total error leaves 64 bits."""
    return 2**28 // max(1, width // parts)


@dataclass(frozen=True)
class Codebooks:
    """Entries as integers, shape (parts, entries, dimension of a part)."""

    entries: np.ndarray

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance of every row of ``parts``.

    Components are at most ``largest_component``. Rows move together, one entry a step;
    those whose search has ended are taken out once they are a fifth of the rest.
    """
    size, width = book.shape
    if not len(parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    # an entry beyond reach at either end stands for "none left on this side"
    sums = np.concatenate(([-_BEYOND], sums[order], [_BEYOND]))
    order = np.concatenate(([size], order, [size]))
    ends = np.zeros((1, width), np.int64)
    ends[0, 0] = _BEYOND // 2
    book = np.concatenate((ends, book, ends))[order + 1]
    all_found, all_best = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    own = parts.sum(axis=1)
    high = np.searchsorted(sums, own)
    low = high - 1
    best = np.full(len(parts), _BEYOND**2 // (4 * width))
    found = np.full(len(parts), size)
    rows = np.arange(len(parts))
    while len(rows):
        gap_low, gap_high = own - sums[low], sums[high] - own
        gap = np.minimum(gap_low, gap_high)
        live = gap * gap <= best * width
        over = len(live) - np.count_nonzero(live)
        if 5 * over > len(live):
            ended = ~live
            all_found[rows[ended]], all_best[rows[ended]] = found[ended], best[ended]
            rows, own, parts, low, high = rows[live], own[live], parts[live], low[live], high[live]
            best, found, gap_low, gap_high = best[live], found[live], gap_low[live], gap_high[live]
        down = gap_low <= gap_high
        at = np.where(down, low, high)
        step = parts - book[at]
        distance = np.einsum("ij,ij->i", step, step)
        index = order[at]
        closer = (distance < best) | ((distance == best) & (index < found))
        np.copyto(best, distance, where=closer)
        np.copyto(found, index, where=closer)
        low = np.maximum(low - down, 0)
        high = np.minimum(high + ~down, size + 1)
    return all_found, all_best


def _vectors(column: pa.Array, width: int, parts: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows that belong to the codebooks, and their integers."""
    limit = largest_component(width, parts)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    rows = np.flatnonzero(lengths == width) if width else np.zeros(0, np.int64)
    flat = np.asarray(pc.list_flatten(column.take(pa.array(rows, pa.int64()))), dtype=np.float64)
    scaled = scale * flat.reshape(len(rows), width) if len(rows) else np.zeros((0, width))
    fits = (np.abs(scaled) <= limit).all(axis=1)
    return rows[fits], np.floor(scaled[fits]).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _is_finite(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def kept_vectors(vectors: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    rows = vectors.select(
        F.col(ident).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    return rows.where(_is_finite(F.col("vector")))


def first_codebooks(kept: DataFrame, parts: int, entries: int, scale: float) -> Codebooks:
    """The parts of the first rows by id that can be coded."""
    length = F.size("vector")
    peak = F.array_max(F.transform("vector", lambda x: F.abs(x * scale)))
    limit = F.floor(F.lit(2**28) / F.greatest(F.lit(1), F.floor(length / parts)))
    usable = kept.where((length > 0) & (length % parts == 0) & (peak <= limit))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    one = usable.orderBy(*order).select("vector").head(1)
    if not one:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    width = len(one[0]["vector"])
    first = usable.where(length == width).orderBy(*order).select("vector").limit(entries).collect()
    whole = np.floor(scale * np.array([r["vector"] for r in first], np.float64)).astype(np.int64)
    return Codebooks(np.ascontiguousarray(whole.reshape(len(whole), parts, width // parts).transpose(1, 0, 2)))


def _sums(books: Codebooks, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        totals = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for table in _chunks(batches):
            _, whole = _vectors(_column(table, "vector"), books.width, parts, scale)
            for p in range(parts):
                piece = np.ascontiguousarray(whole[:, p * width : (p + 1) * width])
                index, _ = nearest_entries(piece, books.entries[p])
                counts[p] += np.bincount(index, minlength=entries)
                for d in range(width):
                    np.add.at(totals[p, :, d], index, piece[:, d])
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(at // max(entries, 1), pa.int32()),
                "entry": pa.array(at % max(entries, 1), pa.int32()),
                "n": pa.array(counts.ravel()[at], pa.int64()),
                "total": pa.array(totals.reshape(-1, width)[at].tolist(), pa.list_(pa.int64())),
            }
        )

    return run


def next_codebooks(kept: DataFrame, books: Codebooks, scale: float = SCALE) -> Codebooks:
    """One round: every part to its nearest entry, every used entry to the mean of its parts."""
    if not books.entries.size:
        return books
    sums = kept.select("vector").mapInArrow(_sums(books, scale), "part int, entry int, n long, total array<long>")
    cells = (
        sums.select("part", "entry", "n", F.posexplode("total").alias("at", "value"))
        .groupBy("part", "entry", "at")
        .agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    )
    entries = books.entries.copy()
    for cell in cells.collect():
        entries[cell["part"], cell["entry"], cell["at"]] = int(cell["value"]) // cell["n"]
    return Codebooks(entries)


def fit_codebooks(
    kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE
) -> Codebooks:
    books = first_codebooks(kept, parts, entries, scale)
    for _ in range(rounds):
        books = next_codebooks(kept, books, scale)
    return books


def _codes(books: Codebooks, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.entries.shape
        for table in _chunks(batches):
            rows, whole = _vectors(_column(table, "vector"), books.width, parts, scale)
            found = np.zeros((len(rows), parts), np.uint8)
            error = np.zeros(len(rows), np.int64)
            for p in range(parts):
                piece = np.ascontiguousarray(whole[:, p * width : (p + 1) * width])
                index, distance = nearest_entries(piece, books.entries[p])
                found[:, p] = index
                error += distance
            codes = np.full(table.num_rows, None, object)
            codes[rows] = [code.tobytes().hex() for code in found]
            errors = np.zeros(table.num_rows, np.int64)
            errors[rows] = error
            missing = np.ones(table.num_rows, bool)
            missing[rows] = False
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": _column(table, "vec_id"),
                    "label": _column(table, "label"),
                    "code": pa.array(codes, pa.string()),
                    "error": pa.array(errors, pa.int64(), mask=missing),
                }
            )

    return run


def encode_vectors(kept: DataFrame, books: Codebooks, scale: float = SCALE) -> DataFrame:
    """Code (two hex digits a part) and squared error of every row."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    return kept.mapInArrow(_codes(books, scale), schema)


def compress_vectors(
    vectors: DataFrame,
    ident: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row."""
    if not 1 <= entries <= 256:
        raise ValueError(f"a code of two hex digits names 1 to 256 entries, not {entries}")
    kept = kept_vectors(whole_texts(vectors), ident, vector, label)
    books = fit_codebooks(kept, parts, entries, rounds, scale)
    coded, _ = stage(encode_vectors(kept, books, scale), "codes")
    # combined before the shuffle, and joined as a table whose size Spark knows
    sums, _ = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    both = coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
