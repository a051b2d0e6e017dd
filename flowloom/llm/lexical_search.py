"""Ranked lexical search by presence-mask grouping.

The items (queries) are taken in blocks of bounded text size, and every document is read
for every block, so neither side has to fit anywhere. For one block of items:

1. Documents are cut into terms and those of the block's vocabulary are counted; the
   counts are written to the shared folder, one row per document.
2. Spark counts documents, terms and documents per term; they give the terms' weights.
3. A task puts its documents into blocks. Each vocabulary term has a bitmap over the
   documents of a block. For an item, the bitmaps of its terms are combined: terms that
   together cannot lift a document to the score it needs are set aside, the union of the other
   bitmaps gives the documents in question, and these are grouped by their mask of matched
   terms. The highest score a mask can reach is the sum of its terms' largest impacts in
   the block. Distinct masks are evaluated by descending highest score, and the item is
   finished with the block when the next mask cannot reach the item's k-th best score.
   That score is carried from block to block, and starts from the k-th best score of a
   64th of the documents, which no final result can be below.
4. A task returns at most k documents per item, and Spark keeps the k best of all.

Nothing is dropped but documents that provably are not among the k best. Only the text of
one block of items and its weights reach the driver.

Defined cases: texts that are null or without terms match nothing and count nowhere.
Rows that repeat an item's id and text are one item; several texts under one id are
ranked apart. Items without an id keep their results under a null id. Documents that repeat
an id are ranked one by one; a null document id comes last among equal scores. Empty
tables give an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import remove, stage, whole_texts

TOP = 10
# text of the items handled in one pass over the documents; a longer item has a pass of its own
BLOCK_BYTES = 1_000_000
# documents per block, fewer if the block's terms would make the table of impacts larger than this
_DOCUMENTS = 2048
_CELLS = 16_000_000
# the starting scores come from one document in so many
_START_SHARE = 64
# Terms are maximal runs of ASCII digits and letters and of non-ASCII characters;
# scores are in millionths of thousandths
_TERM_BYTES = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def terms_of(text: bytes | str | None) -> list[bytes]:
    if not text:
        return []
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return text.translate(_TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _counted(vocabulary: dict[bytes, int]):
    """Length of every document with a term, and its counts of vocabulary terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            rows, lengths, sizes, numbers, counts = [], [], [], [], []
            texts = batch.column("text").cast(pa.large_binary() if pa.types.is_large_string(batch.column("text").type) else pa.binary())
            for row, text in enumerate(texts):
                found = terms_of(text.as_py())
                if not found:
                    continue
                tally = Counter(map(known, found))
                tally.pop(None, None)
                rows.append(row)
                lengths.append(len(found))
                sizes.append(len(tally))
                numbers.extend(tally.keys())
                counts.extend(tally.values())
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    return run


class _Block:
    """Impacts of the terms of some documents, as rows of terms and columns of documents."""

    def __init__(self, terms: np.ndarray, impacts: np.ndarray):
        self.terms = terms
        self.impacts = impacts
        self.bitmaps = np.packbits(impacts > 0, axis=1)
        self.largest = impacts.max(axis=1).astype(np.int64) if len(terms) else np.zeros(0, np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, needed: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of every document that can be among the ``top`` of an item.

        ``needed`` is a score that ``top`` documents are known to reach, or 0. Of the
        documents here with a score of at least ``needed`` and above 0, all that are among
        the ``top`` by any order of equal scores are returned.
        """
        at = np.searchsorted(self.terms, terms)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == terms[here]
        at, weights = at[here], weights[here]
        bounds = weights * self.largest[at] if len(at) else weights[:0]
        if not len(at) or int(bounds.sum()) < max(needed, 1):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(-bounds, kind="stable")
        at, weights, bounds = at[order], weights[order], bounds[order]
        # what is left from each term on; documents with none of the terms before cannot reach more
        rest = bounds[::-1].cumsum()[::-1]
        leading = np.count_nonzero(rest >= max(needed, 1))
        maps = self.bitmaps[at]
        union = np.bitwise_or.reduce(maps[:leading], axis=0)
        columns = np.flatnonzero(np.unpackbits(union, count=self.impacts.shape[1]))
        present = np.unpackbits(maps, axis=1, count=self.impacts.shape[1])[:, columns]
        highest = _mask_bounds(present, bounds)
        keep = highest >= max(needed, 1)
        columns, present, highest = columns[keep], present[:, keep], highest[keep]
        if not len(columns):
            return columns, columns
        masks = np.ascontiguousarray(np.packbits(present, axis=0).T)
        _, first, group = np.unique(masks.view(f"V{masks.shape[1]}").ravel(), return_index=True, return_inverse=True)
        group = group.ravel()
        by_bound = np.argsort(-highest[first], kind="stable")
        members = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(first)))
        got, scores, held = [], [], np.zeros(0, np.int64)
        for start in range(0, len(by_bound), top):
            masks_now = by_bound[start : start + top]
            floor = max(needed, 1)
            if len(held) >= top:
                floor = max(floor, int(np.partition(held, len(held) - top)[len(held) - top]))
            masks_now = masks_now[highest[first[masks_now]] >= floor]
            if not len(masks_now):
                break
            chosen = columns[np.concatenate([members[ends[m - 1] if m else 0 : ends[m]] for m in masks_now])]
            score = weights @ self.impacts[np.ix_(at, chosen)].astype(np.int64)
            reached = score >= floor
            got.append(chosen[reached])
            scores.append(score[reached])
            held = np.concatenate((held, scores[-1]))
        return np.concatenate(got), held


def _mask_bounds(present: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Highest score of each column's mask; exact in floating point below 2**53."""
    if int(bounds.sum()) < 2**53:
        return (bounds.astype(np.float64) @ present).astype(np.int64)
    return bounds @ present.astype(np.int64)


def _blocks(n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, documents: int, total: int):
    """``(start, block)`` over stretches of documents whose table of impacts is bounded."""
    ends = np.cumsum(sizes)
    stack = [(a, min(a + _DOCUMENTS, len(n))) for a in range(0, len(n), _DOCUMENTS)]
    while stack:
        a, b = stack.pop()
        low, high = ends[a] - sizes[a], ends[b - 1]
        kinds, row = np.unique(terms[low:high], return_inverse=True)
        if len(kinds) * (b - a) > _CELLS and b - a > 1:
            stack += [(a, (a + b) // 2), ((a + b) // 2, b)]
            continue
        m = 10 + (90 * n[a:b] * documents) // total
        column = np.repeat(np.arange(b - a), sizes[a:b])
        tf = counts[low:high]
        impacts = np.zeros((len(kinds), b - a), np.int32)
        impacts[row.ravel(), column] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[column])
        yield a, _Block(kinds, impacts)


def _order(entry: tuple) -> tuple:
    score, ident = entry
    return (-score, ident is None, 0 if ident is None else ident)


def _searched(items: list[tuple[np.ndarray, np.ndarray]], start: list[int], documents: int, total: int, top: int, kind: pa.DataType):
    """Up to ``top`` documents of a task for each item, as ``item, doc_id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        needed = list(start)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            lists = batch.column("terms")
            n = np.asarray(batch.column("n"))
            sizes = np.diff(np.asarray(lists.offsets))
            for a, block in _blocks(n, sizes, np.asarray(lists.flatten()), np.asarray(batch.column("counts").flatten()), documents, total):
                for i, (terms, weights) in enumerate(items):
                    rows, scores = block.best(terms, weights, needed[i], top)
                    if not len(rows):
                        continue
                    found = zip(scores.tolist(), ids.take(pa.array(a + rows)).to_pylist(), strict=True)
                    best[i] = sorted([*best[i], *found], key=_order)[:top]
                    if len(best[i]) == top:
                        needed[i] = max(needed[i], best[i][-1][0])
        flat = [(i, ident, score) for i, entries in enumerate(best) for score, ident in entries]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in flat], pa.int32()),
                pa.array([x[1] for x in flat], kind),
                pa.array([x[2] for x in flat], pa.int64()),
            ],
            ["item", "doc_id", "score"],
        )

    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    ordered = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, items: list[tuple], kind: T.StructType, top: int) -> DataFrame:
    """Results of some items, whose ids and texts are here, over all documents."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    numbered = [sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)}) for _, text in items]
    doc_kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", doc_kind),
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )
    counted, path = stage(docs.mapInArrow(_counted(vocabulary), schema), "term-counts")
    documents, total = counted.agg(F.count("*"), F.sum("n")).first()
    holding = np.zeros(len(vocabulary), np.int64)
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[row["term"]] = row["count"]
    weights = np.array([weight(documents, int(h)) if h else 0 for h in holding], np.int64)
    queries = []
    for terms in numbered:
        terms = np.array(terms, np.int32)
        terms = terms[weights[terms] > 0] if len(terms) else terms
        queries.append((terms, weights[terms] if len(terms) else np.zeros(0, np.int64)))
    arrow_kind = pa.schema(_arrow_fields(doc_kind)).field(0).type
    out = T.StructType(
        [T.StructField("item", T.IntegerType()), T.StructField("doc_id", doc_kind), T.StructField("score", T.LongType())]
    )
    start = [0] * len(items)
    some = counted.where(F.pmod(F.xxhash64("doc_id"), F.lit(_START_SHARE)) == 0)
    first = some.mapInArrow(_searched(queries, start, documents, total or 1, top, arrow_kind), out)
    for row in _best(first, top).where(F.col("rank") == top).select("item", "score").collect():
        start[row["item"]] = row["score"]
    found = counted.mapInArrow(_searched(queries, start, documents, total or 1, top, arrow_kind), out)
    ranked, _ = stage(_best(found, top), "ranked")
    remove(spark, path)
    names = spark.createDataFrame([(i, ident) for i, (ident, _) in enumerate(items)], kind)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _arrow_fields(kind: T.DataType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field("doc_id", to_arrow_type(kind))]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item with a score above 0."""
    docs = whole_texts(docs).select("doc_id", "text")
    item_kind = items.schema["item_id"].dataType
    wanted = items.where("text is not null").select("item_id", "text").distinct()
    wanted, _ = stage(wanted.withColumn("bytes", F.octet_length("text")), "items")
    blocks = max(1, -(-(wanted.agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_kind)])
    results = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        part = sorted(((r["item_id"], r["text"]) for r in rows.collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        if not part and blocks > 1:
            continue
        found = _search_block(docs, part, kind, top)
        results = found if results is None else results.unionByName(found)
    return results
