"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

``P(grade >= k) = sigmoid(w . x - theta_k)`` with one weight vector for all thresholds
``theta_1 <= theta_2 <= theta_3``; expected severity is the sum of the three. Toxic is
what reaches grade 1 with at least the chance that separates the training rows best.

Features are hashed: each distinct word (lower-cased, outer signs removed) and, for words
of seven letters or more, its first four, five and six letters; a feature's value is the
number of distinct words that have it. Features that fewer than ``LEAST_DOCUMENTS``
training documents hold, or that do not point to toxic text, have weight 0: clean words
beside an insult take nothing away from it.

The labels are yes or no, so the grades of the training rows are made from them: 0 for
not toxic; toxic documents are ranked by how many words marked by training odds they
hold, and thirds of them are grades 1 to 3 (the fewest marks, 1).

The bound on fitting is ``TRAIN_DOCUMENTS`` labelled documents, chosen by a hash of the
id outside the held-out fold; ids, labels, language and source are never inputs.

Defined cases: null and empty texts have no features and get the base severity; without
a toxic or a clean training row the severity is 0 and nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import MEMO_WORDS, frugal, whole_texts
from flowloom.llm.quality import is_held_out, labelled_sample

DIMENSIONS = 1 << 18
GRADES = 3
TRAIN_DOCUMENTS = 6000
LEAST_DOCUMENTS = 4
LEAST_RATIO = 2.0
MARK_RATIO = 3.0
CUTS = tuple(k / 20 for k in range(2, 11))
ROUNDS, RATE, DECAY = 300, 0.05, 1e-4
_EDGES = "".join(chr(c) for c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F))) + "«»„“”‘’…–—¡¿"


def word_features(word: str) -> list[int]:
    names = ["w" + word]
    if len(word) >= 7:
        names += [f"{n}{word[:n]}" for n in (4, 5, 6)]
    return [xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) % DIMENSIONS for n in names]


def distinct_words(text: str | None) -> set[str]:
    words = {w.strip(_EDGES) for w in text.lower().split()} if text else set()
    words.discard("")
    return words


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text."""
    found = [f for word in distinct_words(text) for f in word_features(word)]
    return np.unique(np.array(found, np.int64), return_counts=True)


@dataclass
class OrdinalModel:
    weights: np.ndarray  # one per feature, shared by all thresholds
    thresholds: np.ndarray
    cut: float = 0.5  # least P(grade >= 1) that counts as toxic

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..GRADES, from w . x."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -500, 500)))


def fit_ordinal(features: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> OrdinalModel:
    none = OrdinalModel(np.zeros(DIMENSIONS), np.full(GRADES, 500.0))
    bad = int(toxic.sum())
    if not bad or bad == len(toxic):
        return none
    row = np.repeat(np.arange(len(features)), [len(f) for f, _ in features])
    column = np.concatenate([f for f, _ in features])
    value = np.concatenate([v for _, v in features]).astype(np.float64)
    in_bad = np.bincount(column, weights=toxic[row], minlength=DIMENSIONS)
    in_all = np.bincount(column, minlength=DIMENSIONS)
    odds = np.log((in_bad + 0.5) / (bad + 1.0)) - np.log((in_all - in_bad + 0.5) / (len(toxic) - bad + 1.0))
    used = (in_all >= LEAST_DOCUMENTS) & (odds >= LEAST_RATIO)
    kept = used[column]
    row, column, value = row[kept], column[kept], np.log1p(value[kept])
    marks = np.bincount(row, weights=odds[column] >= MARK_RATIO, minlength=len(features))
    grades = np.zeros(len(features), np.int64)
    rank = pd.Series(marks[toxic > 0]).rank(method="average", pct=True).to_numpy()
    grades[toxic > 0] = np.clip(np.ceil(rank * GRADES), 1, GRADES)
    value = value * odds[column]  # weights start equal in units of log odds
    reached = (grades[:, None] >= np.arange(1, GRADES + 1)[None, :]).astype(np.float64)
    share = np.clip(reached.mean(0), 1e-4, 1 - 1e-4)
    model = OrdinalModel(np.where(used, 0.1, 0.0), np.log(1 / share - 1))
    params = [model.weights, model.thresholds]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, ROUNDS + 1):
        margin = np.bincount(row, weights=value * model.weights[column], minlength=len(features))
        miss = (model.at_least(margin) - reached) / len(features)
        gradients = [
            np.bincount(column, weights=value * miss.sum(1)[row], minlength=DIMENSIONS) + DECAY * model.weights / GRADES,
            -miss.sum(0),
        ]
        for p, g, m, v in zip(params, gradients, moment, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.thresholds.sort()
    margin = np.bincount(row, weights=value * model.weights[column], minlength=len(features))
    chance = model.at_least(margin)[:, 0]
    cut = max(CUTS, key=lambda c: (_f1(chance >= c, toxic > 0), c))
    return OrdinalModel(np.where(used, model.weights * odds, 0.0), model.thresholds, cut)


def _f1(found: np.ndarray, true: np.ndarray) -> float:
    return 2.0 * float((found & true).sum()) / max(float(found.sum() + true.sum()), 1.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> OrdinalModel:
    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [text_features(t) for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "f": [f.astype(np.int32).tobytes() for f, _ in pairs], "v": [np.minimum(v, 60000).astype(np.uint16).tobytes() for _, v in pairs]})

    rows = labelled_sample(docs, labels, label, TRAIN_DOCUMENTS, id_col, text_col).mapInPandas(frugal(featured), "y double, f binary, v binary").collect()
    rows.sort(key=lambda r: bytes(r["f"]))  # the same fit whatever order rows arrive in
    features = [(np.frombuffer(bytes(r["f"]), np.int32), np.frombuffer(bytes(r["v"]), np.uint16)) for r in rows]
    return fit_ordinal(features, np.array([float(r["y"] > 0) for r in rows]))


def _graded(model: OrdinalModel):
    used = np.flatnonzero(model.weights)
    known = dict(zip(used.tolist(), model.weights[used].tolist(), strict=True))
    thresholds = model.thresholds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple] = {}
        scorer = OrdinalModel(np.zeros(0), thresholds)
        for batch in batches:
            margins = np.zeros(len(batch))
            for i, text in enumerate(batch["text"]):
                values: dict[int, int] = {}
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                for word in distinct_words(text):
                    features = memo.get(word)
                    if features is None:
                        features = memo[word] = tuple(f for f in word_features(word) if f in known)
                    for f in features:
                        values[f] = values.get(f, 0) + 1
                margins[i] = sum(known[f] * np.log1p(values[f]) for f in sorted(values))
            above = scorer.at_least(margins)
            exact = -np.diff(np.concatenate([np.ones((len(batch), 1)), above, np.zeros((len(batch), 1))], axis=1), axis=1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "severity": above.sum(1), "grade": exact.argmax(1), "p_toxic": above[:, 0]})

    return run


def grade_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, held_out, severity (0 to 3), grade, p_toxic, toxic`` for every row."""
    source = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = source.mapInPandas(frugal(_graded(model)), "doc_id long, severity double, grade int, p_toxic double")
    return rows.select(F.col("doc_id").alias(id_col), is_held_out("doc_id").alias("held_out"), "severity", "grade", "p_toxic", (F.col("p_toxic") >= model.cut).alias("toxic"))
