"""Document quality from random-indexing word vectors and a small neural network.

1. Random indexing over every document: each token bucket has a fixed sparse ternary
   index vector; its word vector is the sum of the index vectors of the tokens beside it
   (``WINDOW`` to either side) in the whole corpus. A task adds up its own co-occurrence
   counts and sends one row per bucket; Spark sums them. ``BUCKETS * WIDTH`` numbers reach
   the driver, whatever the corpus holds.
2. A document is the mean and the standard deviation of its tokens' unit word vectors, and
   the mean product of neighbouring ones, which tells repetition from running text.
3. A two-layer numpy network is fitted on at most about ``TRAIN_DOCUMENTS`` labelled
   documents (the bound on fitting; chosen by a hash of the id outside the held-out fold),
   and its logits are divided by a temperature fitted on a part it was not trained on.

A token is a run of letters (lower-cased; all-capital words are one token), a number
(all numbers are one token) or a run of other signs. Labels, language, source and id are
never inputs of a score.

Defined cases: null and empty texts pool to zeros and are scored like that; without a
labelled row of either class every score is the share of good rows, or 0.5 without labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import MEMO_WORDS, frugal, hash_limit, hash_rank, new_memo, whole_texts

BUCKETS, WIDTH, NONZERO, WINDOW = 4096, 64, 6, 2
POOLED = 3 * WIDTH
TRAIN_DOCUMENTS = 6000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 128, 3e-3, 1e-4
FOLDS, HELD_OUT = 5, 0
CUTOFF = 0.3
_ROWS = 256
_ONE = np.uint32(1)  # of the type of the counts: any other is added many times slower
_TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
_memo = new_memo()


def _index_vectors() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(11))
    vectors = np.zeros((BUCKETS, WIDTH))
    for row in vectors:
        row[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return vectors


def _bucket(token: str) -> int:
    if token[0].isdigit():
        token = "0"
    elif len(token) > 1 and token.isupper():
        token = "A"
    return xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS


def token_buckets(text: str | None) -> np.ndarray:
    memo = _memo
    if len(memo) > MEMO_WORDS:
        memo.clear()
    tokens = _TOKEN.findall(text) if text else []
    found = list(map(memo.get, tokens))
    if None in found:
        for i, bucket in enumerate(found):
            if bucket is None:
                found[i] = memo[tokens[i]] = _bucket(tokens[i])
    return np.array(found, dtype=np.int64)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    together = np.zeros(BUCKETS * BUCKETS, np.uint32)
    for batch in batches:
        for text in batch["text"]:
            tokens = token_buckets(text)
            for apart in range(1, WINDOW + 1):
                if len(tokens) > apart:
                    np.add.at(together, tokens[:-apart] * BUCKETS + tokens[apart:], _ONE)
    counts = together.reshape(BUCKETS, BUCKETS)
    used = np.flatnonzero(counts.any(1) | counts.any(0))
    if len(used):
        index, sums = _index_vectors(), np.zeros((BUCKETS, WIDTH))
        for at in range(0, BUCKETS, _ROWS):  # a few rows at a time become floating point
            some = counts[at : at + _ROWS].astype(np.float64)
            sums[at : at + _ROWS] += some @ index
            sums += some.T @ index[at : at + _ROWS]
        yield pd.DataFrame(sums[used], columns=[f"v{i}" for i in range(WIDTH)]).assign(bucket=used)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vector per token bucket, from all documents."""
    names = [f"v{i}" for i in range(WIDTH)]
    kinds = ", ".join(f"{n} double" for n in names) + ", bucket int"
    parts = whole_texts(docs).select(F.col(text_col).cast("string").alias("text")).mapInPandas(frugal(_contexts), kinds)
    rows = parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).collect()
    vectors = np.zeros((BUCKETS, WIDTH))
    for row in rows:
        vectors[row["bucket"]] = [row[n] for n in names]
    length = np.sqrt((vectors**2).sum(1, keepdims=True))
    return (vectors / np.where(length > 0, length, 1.0)).astype(np.float32)


def pooled(vectors: np.ndarray, text: str | None) -> np.ndarray:
    tokens = token_buckets(text)
    if not len(tokens):
        return np.zeros(POOLED)
    rows = vectors[tokens]
    mean = rows.mean(0, dtype=np.float64)
    square = np.einsum("ij,ij->j", rows, rows, dtype=np.float64) / len(rows)
    beside = np.einsum("ij,ij->j", rows[1:], rows[:-1], dtype=np.float64) / max(len(rows) - 1, 1)
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0.0)), beside])


def pool_all(vectors: np.ndarray, texts: pd.Series) -> np.ndarray:
    return np.stack([pooled(vectors, t) for t in texts]) if len(texts) else np.zeros((0, POOLED))


@dataclass
class Network:
    """tanh layer and a sigmoid, on standardised inputs, with a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    offset: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.first + self.bias) @ self.second + self.offset

    def scores(self, x: np.ndarray) -> np.ndarray:
        # nine digits: the last ones depend on which rows share a batch
        return np.round(1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500))), 9)


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0.0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Fit on four fifths of the rows, the temperature on the last fifth."""
    rng = np.random.Generator(np.random.PCG64(seed))
    inputs = x.shape[1]
    blank = Network(np.zeros(inputs), np.ones(inputs), np.zeros((inputs, 1)), np.zeros(1), np.zeros(1), 0.0)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        blank.offset = float(np.log(share / (1 - share)))
        return blank
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    tune, train = order[:cut], order[cut:]
    centre, scale = x[train].mean(0), x[train].std(0) + 1e-6
    net = Network(centre, scale, rng.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (x - centre) / scale
    params = [net.first, net.bias, net.second, np.zeros(1)]
    moment, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            logit = hidden @ params[2] + params[3][0]
            delta = (1.0 / (1.0 + np.exp(-logit)) - y[rows]) / len(rows)
            back = delta[:, None] * params[2][None, :] * (1 - hidden**2)
            gradients = [z[rows].T @ back + DECAY * params[0], back.sum(0), hidden.T @ delta + DECAY * params[2], np.array([delta.sum()])]
            step += 1
            for p, g, m, v in zip(params, gradients, moment, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.offset = float(params[3][0])
    logits = net.logits(x[tune])
    net.temperature = float(min(np.exp(np.linspace(-1.5, 3.0, 91)), key=lambda t: _loss(logits / t, y[tune])))
    return net


def is_held_out(doc_id: str, folds: int = FOLDS, fold: int = HELD_OUT) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: int = HELD_OUT) -> DataFrame:
    """``text, y`` of ``bound`` labelled documents outside the held-out fold, or of all if
    they are fewer: the first in an order by a hash of the id, so that the sample is the
    same in every run. The chosen ids, at most ``bound`` rows, are broadcast. Of rows that
    repeat an id one text is taken, the least."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    named = named.where(~is_held_out("id", folds, fold)).groupBy("id").agg(F.max("y").alias("y"))
    ranked = named.withColumn("_h", hash_rank("id", 29))
    # twice as many as wanted pass the threshold, so that no more have to be sorted
    some = ranked.where(F.col("_h") <= hash_limit(2 * bound, named.count()))
    chosen = some.orderBy("_h", "id").limit(bound).select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return found.select("text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors of the corpus and the network fitted on the labelled sample."""
    vectors = word_vectors(docs, text_col)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [pooled(vectors, t).tobytes() for t in batch["text"]]})

    rows = labelled_sample(docs, labels, label, TRAIN_DOCUMENTS, id_col, text_col).mapInPandas(frugal(pool), "y double, x binary").collect()
    rows.sort(key=lambda r: bytes(r["x"]))  # the same fit whatever order rows arrive in
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float64).reshape(-1, POOLED)
    return vectors, fit_network(x, np.array([r["y"] for r in rows]))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, held_out, score, predicted`` for every row."""
    vectors, net = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": net.scores(pool_all(vectors, batch["text"]))})

    source = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = source.mapInPandas(frugal(run), "doc_id long, score double")
    return rows.select(
        F.col("doc_id").alias(id_col), is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted")
    )


def is_good(model: tuple[np.ndarray, Network], cutoff: float = CUTOFF):
    """Column function: whether a text is scored at least ``cutoff``."""
    vectors, net = model

    @F.pandas_udf(T.BooleanType())
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(net.scores(pool_all(vectors, texts)) >= cutoff)

    return good
