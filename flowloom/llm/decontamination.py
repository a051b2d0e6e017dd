"""Benchmark decontamination by spaced seeds.

A seed is a hash of the words under a fixed mask; where the mask has a 0 the word may be
anything, so a passage still shares seeds after words were replaced. Test items and
documents are hashed with the same masks, equal hashes are joined, and each hit names a
diagonal (place in the document minus place in the item). Around the diagonals of an item
the words of document and item are aligned, and the best stretch (+1 for an equal word,
-``MISMATCH`` for a replaced, added or left-out one) is the overlap. A document is
contaminated by an item when the stretch has at least ``LEAST_WORDS`` equal words and
either ``LEAST_SHARE`` of the item's words or ``LONG_RUN`` equal words, however long the
item is. Of items up to 14 words all words must be equal but one (8 words or more) or two
(11 or more), and items of fewer than ``UNBROKEN`` words, which stand in ordinary text by
chance, contaminate only a document that consists of nothing else.

Words may be added or left out anywhere as long as ``UNBROKEN`` words in a row stay equal
somewhere, or a mask fits; one replaced word always leaves either.

The test side is broadcast while it has at most ``BROADCAST_SEEDS`` seeds; the join then
happens while a document is read, and nothing is shuffled. Beyond that the hashes of both
sides are joined by a shuffle and the words travel only to the diagonals found.

Words are runs of letters, digits and underscores, lower-cased.

Defined cases: null or empty texts match nothing, on either side; a null ``doc_id`` is
carried along; repeated documents are reported once per row and item. Items are told by id
and text: several texts under one id all count, an item without an id counts under a null
one, and rows that repeat both are one item. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import MEMO_WORDS, frugal, mix, new_memo, stage, whole_texts

UNBROKEN = 5
MASKS = ("11101100111", "11011010111", "10110111011", "11100111011", "1" * UNBROKEN)
SPAN = len(MASKS[0])
LEAST_WORDS, LONG_RUN, LEAST_SHARE, MISMATCH = 12, 13, 0.5, 2
SHORT_ITEM = 14
# for items of 8 and 9 words, where a replaced word in the middle leaves no unbroken run
SHORT_MASKS = {8: ("11101111", "11110111"), 9: ("111101111",)}
BROADCAST_SEEDS = 4_000_000
_WORD = re.compile(r"\w+")
_MULTIPLIERS = mix(np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_memo = new_memo()
RESULT = "doc_id long, item_id long, item_words int, equal_words int, run_words int, first_word long, share double"


def words_of(text: str | None) -> np.ndarray:
    memo = _memo
    if len(memo) > MEMO_WORDS:
        memo.clear()
    words = _WORD.findall(text.lower()) if text else []
    found = list(map(memo.get, words))
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                found[i] = memo[words[i]] = xxhash.xxh3_64_intdigest(words[i].encode("utf-8", "surrogatepass"))
    return np.array(found, dtype=np.uint64)


def seeds_of(words: np.ndarray, lengths: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes of a text and the places where their masks start; ``lengths`` are the
    numbers of words of items that have masks of their own. A text shorter than every mask
    has one seed, for all of it."""
    hashes, places = [], []
    shapes = [(i, mask) for i, mask in enumerate(MASKS)]
    shapes += [(10 * n + i, mask) for n in lengths for i, mask in enumerate(SHORT_MASKS[n])]
    if 0 < len(words) < UNBROKEN:
        shapes.append((1000 + len(words), "1" * len(words)))
    for salt, mask in shapes:
        count = len(words) - len(mask) + 1
        if count > 0:
            total = np.full(count, salt, np.uint64)
            for i, bit in enumerate(mask):
                if bit == "1":
                    total += words[i : i + count] * _MULTIPLIERS[i]
            hashes.append(mix(total))
            places.append(np.arange(count))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def overlap(document: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(equal words, words, first word in the document) of the best run on a diagonal, or
    of all that is equal on it for a short item, whose first words may stand before a replaced one."""
    low, high = max(0, -diagonal), min(len(item), len(document) - diagonal)
    equal = item[low:high] == document[low + diagonal : high + diagonal]
    if len(item) <= SHORT_ITEM:
        at = np.flatnonzero(equal)
        return (len(at), int(at[-1] - at[0]) + 1, int(low + diagonal + at[0])) if len(at) else (0, 0, low + diagonal)
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    floor = np.minimum.accumulate(total)
    end = int(np.argmax(total - floor))
    start = int(np.argmin(total[: end + 1]))
    return int(equal[start:end].sum()), end - start, low + diagonal + start


def aligned(document: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(equal words, words of the document, first word in the document) of the best stretch
    in which words may be replaced, added or left out; it ends where its score is highest.
    One pass over the item's words, with the document's words as columns."""
    column = np.arange(len(document) + 1)
    score, equal, peak, start = np.zeros_like(column), np.zeros_like(column), np.zeros_like(column), column
    best = (0, 0, 0)
    for word in item:
        match = document == word
        on, left_out = score[:-1] + np.where(match, 1, -MISMATCH), score[1:] - MISMATCH
        skip = left_out > on
        value = np.concatenate([[0], np.maximum(on, left_out)])
        counts = np.concatenate([[0], np.where(skip, equal[1:], equal[:-1] + match)])
        peaks = np.concatenate([[0], np.where(skip, peak[1:], peak[:-1])])
        starts = np.concatenate([[0], np.where(skip, start[1:], start[:-1])])
        fresh = value <= 0
        value[fresh], counts[fresh], peaks[fresh], starts[fresh] = 0, 0, 0, column[fresh]
        # words added in the document: the best earlier column, less the words in between
        origin = np.maximum.accumulate((value + MISMATCH * column) * len(column) + column) % len(column)
        score, equal, start = value[origin] - MISMATCH * (column - origin), counts[origin], starts[origin]
        ends = (origin[1:] == column[1:]) & match & ~skip & (score[1:] >= peaks[1:])
        peak = np.maximum(peaks[origin], score)
        if ends.any():
            at = int(np.argmax(np.where(ends, equal[1:], 0))) + 1
            if (equal[at], -start[at]) > (best[0], -best[2]):
                best = (int(equal[at]), int(at - start[at]), int(start[at]))
    return best


def needed(item_words: int) -> int:
    """Equal words that make a document contaminated by an item of so many words."""
    if item_words <= SHORT_ITEM:
        return item_words - (item_words >= 8) - (item_words >= 11)
    return max(LEAST_WORDS, min(LONG_RUN, int(np.ceil(LEAST_SHARE * item_words))))


def _windows(diagonals: list[int], item_words: int, document_words: int) -> list[tuple[int, int]]:
    """Stretches of a document that an overlap on or next to the diagonals can reach; more
    than half of the item's words added would outweigh all equal ones."""
    slack, out = item_words // MISMATCH + 1, []
    for diagonal in sorted(diagonals):
        low, high = max(0, diagonal - slack), min(document_words, diagonal + item_words + slack)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def _best(document: np.ndarray, pairs: list[tuple[int, int]], items: dict[int, np.ndarray]) -> list[tuple]:
    """Best overlap of a document with each item, of the (item, diagonal) pairs given."""
    diagonals: dict[int, list[int]] = {}
    for item, diagonal in pairs:
        diagonals.setdefault(item, []).append(diagonal)
    rows = []
    for item, found in sorted(diagonals.items()):
        words = items[item]
        least = needed(len(words))
        equal, negative, run = max((e, -first, run) for e, run, first in (overlap(document, words, d) for d in found))
        if equal < len(words):
            for low, high in _windows(found, len(words), len(document)):
                part = document[low:high]
                # neither side can have more equal words than words that stand in the other
                if min(np.isin(part, words).sum(), np.isin(words, part).sum()) >= max(least, equal):
                    e, r, first = aligned(part, words)
                    equal, negative, run = max((equal, negative, run), (e, -(first + low), r))
        if equal >= least:
            rows.append((item, len(words), equal, run, -negative, equal / len(words)))
    return rows


def _item_seeds(lengths: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                words = words_of(text)
                if len(words):
                    hashes, places = seeds_of(words, (len(words),) if len(words) in lengths else ())
                    yield pd.DataFrame({"seed": hashes.view(np.int64), "item_id": item, "place": places})

    return run


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"item_id": batch["item_id"], "words": [words_of(t).tobytes() for t in batch["text"]]})


def _scan(seeds: pd.DataFrame, items: dict[int, np.ndarray], lengths: tuple[int, ...]):
    """Documents against a broadcast test side."""
    seeds = seeds.sort_values(["seed", "item_id", "place"], kind="stable")
    keys = seeds["seed"].to_numpy(np.int64)
    names, places = seeds["item_id"].to_numpy(np.int64), seeds["place"].to_numpy(np.int64)
    present = np.zeros(1 << 24, bool)
    present[keys.view(np.uint64) >> np.uint64(40)] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                hashes, at = seeds_of(words, lengths)
                maybe = present[hashes >> np.uint64(40)]
                hashes, at = hashes[maybe].view(np.int64), at[maybe]
                low, high = np.searchsorted(keys, hashes, side="left"), np.searchsorted(keys, hashes, side="right")
                spans = high - low
                if not spans.any():
                    continue
                hit = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
                pairs = np.unique(np.stack([names[hit], np.repeat(at, spans) - places[hit]], axis=1), axis=0)
                rows += [(doc, *found) for found in _best(words, [tuple(p) for p in pairs.tolist()], items)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})

    return run


def _document_seeds(lengths: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                hashes, at = seeds_of(words_of(text), lengths)
                yield pd.DataFrame({"seed": hashes.view(np.int64), "row": row, "at": at})

    return run


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row, doc, text, item, words, diagonals in batch[["row", "doc_id", "text", "item_id", "words", "diagonals"]].itertuples(index=False):
            items = {item: np.frombuffer(words, np.uint64)}
            rows += [(doc, *found) for found in _best(words_of(text), [(item, int(d)) for d in diagonals], items)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row per contaminated document and item: ``<id>, item_id, item_words,
    equal_words, run_words, first_word, share``. Clean documents have no row."""
    source = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = benchmark.select(F.col(item_col).cast("long").alias("name"), F.col(item_text).cast("string").alias("text"))
    given = given.where("text is not null").distinct()
    # an item is an id with a text, either of which may stand in several rows
    given, _ = stage(given.withColumn("item_id", F.xxhash64(F.col("name").isNull(), "name", "text")), "tests")
    tests = given.select("item_id", "text")
    words, _ = stage(tests.mapInPandas(_item_words, "item_id long, words binary").dropDuplicates(["item_id"]), "items")
    short = words.select((F.length("words") / 8).cast("int").alias("n")).where(F.col("n").isin(*SHORT_MASKS)).distinct()
    lengths = tuple(sorted(r["n"] for r in short.collect()))
    seeds, _ = stage(tests.mapInPandas(_item_seeds(lengths), "seed long, item_id long, place long").distinct(), "seeds")
    if seeds.count() <= broadcast_seeds:
        words = words.where(F.length("words") > 0)  # no more items than seeds
        items = {r["item_id"]: np.frombuffer(bytes(r["words"]), np.uint64) for r in words.collect()}
        found = source.mapInPandas(frugal(_scan(seeds.toPandas(), items, lengths)), RESULT)
    else:
        rows, _ = stage(source.where("text is not null").withColumn("row", F.monotonically_increasing_id()), "texts")
        hits = rows.mapInPandas(frugal(_document_seeds(lengths)), "seed long, row long, at long").join(seeds, "seed")
        diagonals = hits.select("row", "item_id", (F.col("at") - F.col("place")).alias("_d")).groupBy("row", "item_id").agg(F.collect_set("_d").alias("diagonals"))
        found = diagonals.join(words, "item_id").join(rows, "row").mapInPandas(frugal(_verify), RESULT)
    names = given.select(F.col("item_id").alias("key"), F.col("name").alias("item_id"))
    named = found.withColumnRenamed("item_id", "key").join(names, "key")
    return named.select(*[c.split()[0] for c in RESULT.split(", ")]).withColumnRenamed("doc_id", id_col)
