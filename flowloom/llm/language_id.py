"""Language identification by prediction by partial matching.

Per language a context tree of bytes up to ``ORDER`` deep is counted on a bounded sample
of labelled documents. The statistics are then frozen: a byte ``s`` after a context
seen ``n`` times with ``q`` different followers costs ``-log2(n_s / (n + q))`` if it
followed before, else the escape ``-log2(q / (n + q))`` and what it costs in the next
shorter context; contexts never seen cost nothing to leave, and below order 0 all bytes
cost 8 bits. The code length of a text is the sum over all its bytes, so it is exact, and
the language with the shortest code wins (ties: the first by name). ``score`` is its
posterior under equal priors.

The trees of all languages share one table of grams with a column per language in which
escapes are already resolved, so a text costs a few array lookups per byte.

The sample is the bound on fitting: per language at most ``TRAIN_DOCUMENTS`` documents
and ``TRAIN_BYTES`` bytes, whole texts in the order of a hash of the id.

Defined cases: null text, and text without any letter, is ``und`` with score 0; so is
everything if nothing was labelled. Rows without a language or an id are not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowloom.llm.common import forget, frugal, hash_limit, hash_rank, whole_texts

ORDER = 3
TRAIN_DOCUMENTS = 500
TRAIN_BYTES = 2_000_000
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
LEAST_SCORE = 0.5
_PAD = b"\n" * ORDER
_CHUNK = 1_000_000
_LETTER = re.compile(r"[^\W\d_]")


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """Big-endian numbers of the ``length`` bytes that end at each place from ORDER on."""
    value = np.zeros(len(data) - ORDER, np.int64)
    for back in range(length - 1, -1, -1):
        value = (value << 8) | data[ORDER - back : len(data) - back]
    return value


class ContextTrees:
    """Frozen byte statistics of several languages, ready for scoring."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        width = len(self.languages)
        counted = []  # per language: {length: (grams, counts)}
        for language in self.languages:
            found = {}
            encoded = [np.frombuffer(_PAD + t.encode("utf-8", "surrogatepass"), np.uint8) for t in samples[language]]
            for length in range(1, ORDER + 2):
                parts = [_grams(e, length) for e in encoded]
                found[length] = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
            counted.append(found)
        # cost[k]: bits of the last byte of a gram of k bytes; leave[k]: bits to leave a context of k bytes
        self.keys, self.cost, self.leave_keys, self.leave = {}, {}, {}, {}
        for length in range(1, ORDER + 2):
            keys = np.unique(np.concatenate([c[length][0] for c in counted])) if width else np.zeros(0, np.int64)
            cost = np.zeros((len(keys), width))
            contexts = np.unique(keys >> 8)
            leave = np.zeros((len(contexts), width))
            shorter = self._resolved(length - 1, keys & ((1 << 8 * (length - 1)) - 1), width)
            for column, found in enumerate(counted):
                grams, counts = found[length]
                at, kinds = np.unique(grams >> 8, return_counts=True)
                totals = np.bincount(np.searchsorted(at, grams >> 8), weights=counts, minlength=len(at))
                place = np.searchsorted(contexts, at)
                leave[place, column] = -np.log2(kinds / (totals + kinds))
                where = np.searchsorted(contexts, keys >> 8)
                cost[:, column] = leave[where, column] + shorter[:, column]
                spot = np.searchsorted(at, grams >> 8)
                cost[np.searchsorted(keys, grams), column] = -np.log2(counts / (totals[spot] + kinds[spot]))
            self.keys[length], self.cost[length] = keys, cost
            self.leave_keys[length - 1], self.leave[length - 1] = contexts, leave

    def _resolved(self, length: int, grams: np.ndarray, width: int) -> np.ndarray:
        """Bits of the last byte of any grams of ``length`` bytes, escapes included."""
        if length == 0:
            return np.full((len(grams), width), 8.0)
        out = np.empty((len(grams), width))
        at = np.minimum(np.searchsorted(self.keys[length], grams), max(len(self.keys[length]) - 1, 0))
        known = self.keys[length][at] == grams if len(self.keys[length]) else np.zeros(len(grams), bool)
        out[known] = self.cost[length][at[known]]
        rest = ~known
        if rest.any():
            missing = grams[rest]
            value = self._resolved(length - 1, missing & ((1 << 8 * (length - 1)) - 1), width)
            contexts = self.leave_keys[length - 1]
            at = np.minimum(np.searchsorted(contexts, missing >> 8), max(len(contexts) - 1, 0))
            seen = contexts[at] == missing >> 8 if len(contexts) else np.zeros(len(missing), bool)
            value[seen] += self.leave[length - 1][at[seen]]
            out[rest] = value
        return out

    def index(self) -> None:
        """Direct tables: context of ORDER bytes, then the byte after it, to a row of costs."""
        top = ORDER + 1
        contexts = self.leave_keys[ORDER]
        self.context_row = np.zeros(1 << 8 * ORDER, np.int32)
        self.context_row[contexts] = np.arange(1, len(contexts) + 1)
        self.gram_row = np.zeros((len(contexts) + 1) * 256, np.int32)
        rows = self.context_row[self.keys[top] >> 8].astype(np.int64) * 256 + (self.keys[top] & 255)
        self.gram_row[rows] = np.arange(1, len(self.keys[top]) + 1)
        self.columns = [np.concatenate([[0.0], self.cost[top][:, c]]) for c in range(len(self.languages))]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        group, rows, size = [], [], 0
        for i, text in enumerate(texts):
            if text:
                group.append(text)
                rows.append(i)
                size += len(text)
            if group and (size >= _CHUNK or i == len(texts) - 1):
                out[rows] = self._bits(group)
                group, rows, size = [], [], 0
        return out

    def _bits(self, texts: list[bytes]) -> np.ndarray:
        data = np.frombuffer(_PAD + _PAD.join(texts), np.uint8)
        wide = data.astype(np.int32)
        context = (wide[: len(data) - 3] << 16) | (wide[1 : len(data) - 2] << 8) | wide[2 : len(data) - 1]
        rows = self.gram_row[self.context_row[context] * np.int64(256) + data[ORDER:]]
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + ORDER)])
        # the padding before later texts is not part of any text
        ends = starts + lengths
        for end in ends[:-1].tolist():
            rows[end : end + ORDER] = 0
        totals = np.stack([np.add.reduceat(column[rows], starts) for column in self.columns], axis=1)
        open_ = rows == 0
        for end in ends[:-1].tolist():
            open_[end : end + ORDER] = False
        missing = np.flatnonzero(open_)
        if len(missing):
            grams = (context[missing].astype(np.int64) << 8) | data[ORDER:][missing]
            distinct, back = np.unique(grams, return_inverse=True)
            value = self._resolved(ORDER + 1, distinct, len(self.languages))[back]
            owner = np.searchsorted(starts, missing, side="right") - 1
            for column in range(len(self.languages)):
                totals[:, column] += np.bincount(owner, weights=value[:, column], minlength=len(texts))
        return totals


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    """Context trees from a bounded sample of the rows outside the held-out fold."""
    rows = whole_texts(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("id"))
    labelled = labelled.where(F.octet_length("text") <= TRAIN_BYTES).withColumn("_h", hash_rank("id", 17))
    share = {r["lang"]: hash_limit(2 * TRAIN_DOCUMENTS, r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return ContextTrees({})
    limit = F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, v)))
    order = Window.partitionBy("lang").orderBy("_h", "id", F.xxhash64("text"))
    chosen = (
        labelled.where(F.col("_h") <= F.element_at(limit, F.col("lang")))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= TRAIN_DOCUMENTS)
        .withColumn("_b", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_b") <= TRAIN_BYTES)
    )
    samples: dict[str, list[str]] = {language: [] for language in share}
    for row in chosen.select("lang", "text").toLocalIterator():
        samples[row["lang"]].append(row["text"])
    return ContextTrees({k: v for k, v in samples.items() if v})


def identify(trees: ContextTrees, texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each text."""
    if trees.languages and not hasattr(trees, "gram_row"):
        trees.index()
    names = np.array([*trees.languages, UNKNOWN], dtype=object)
    letters = np.array([bool(t) and bool(trees.languages) and _LETTER.search(t) is not None for t in texts], bool)
    encoded = [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts, letters, strict=True)]
    best, score, bits = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.zeros(len(texts))
    if letters.any():
        lengths = trees.code_lengths(encoded)[letters]
        best[letters] = lengths.argmin(1)
        least = lengths.min(1, keepdims=True)
        score[letters] = 1.0 / np.exp2(np.maximum(least - lengths, -1000.0)).sum(1)
        bits[letters] = least[:, 0] / np.array([len(t) for t in encoded])[letters]
    return names[best], score, bits


def _identified(trees: ContextTrees):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            language, score, bits = identify(trees, batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": language, "score": score, "bits_per_byte": bits})

    return run


def has_language(trees: ContextTrees, least: float = LEAST_SCORE):
    """Column function: whether a text has an identified language."""

    @F.pandas_udf(T.BooleanType())
    def accepted(texts: pd.Series) -> pd.Series:
        forget()
        language, score, _ = identify(trees, texts)
        return pd.Series((language != UNKNOWN) & (score >= least))

    return accepted


def identify_languages(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, held_out, lang_pred, score, bits_per_byte`` for every row."""
    source = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = source.mapInPandas(frugal(_identified(trees)), "doc_id long, lang_pred string, score double, bits_per_byte double")
    return rows.select(F.col("doc_id").alias(id_col), is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")
