"""Token counts of every prefix of a text, by prefix dynamic programming.

For a piece vocabulary merged by rank (byte-pair encoding), the encoding of a prefix
``s[:i]`` is the encoding of ``s[:i - len(t)]`` followed by its last piece ``t``, for
exactly one ``t``; ``t`` fits when it and the piece before it, encoded together, come
out as the same two pieces. So ``count[i] = count[i - len(t)] + 1`` gives the exact
token count of every prefix in one pass, and truncation or budget questions are lookups
in the stored counts, not new encodings.

No piece reaches across the start of a run of spaces or across a line end, so the table
is made per unit (a word with the spaces before it) and a text's table is the units'
tables one after the other. A worker keeps the units it has seen, up to ``MEMO_UNITS``.
The table is stored as one signed byte per code point: the change of the count.

Defined cases: null counts as empty; an empty text has 0 bytes, 0 tokens and an empty
table; characters outside the vocabulary count one token per UTF-8 byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import frugal, mix, new_memo, whole_texts

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MEMO_UNITS = 250_000
GROUP_CHARS = 2_000_000
_PAIR_BITS = 21
_START, _OUTSIDE = -1, -2
_ONE, _GOLD = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = "▁"
_POWERS = np.cumprod(np.full(63, _BASE, np.uint64), dtype=np.uint64)
_POWERS = np.concatenate([np.ones(1, np.uint64), _POWERS])
_UNITS = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|\n[^{_SPACE}\n]*")


class PrefixCounter:
    """Prefix tables for a sentencepiece BPE model with byte fallback.

    All new units of a batch go through the recurrence together, one array step per
    (end, length); whether two pieces stay apart is asked of the model once per pair.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        whole = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if not (whole and model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback):
            raise ValueError("needs a BPE model with byte fallback, identity normalisation and a leading space")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(p.piece, i) for i, p in enumerate(model.pieces) if p.type == 1]
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p, _ in pieces):
            raise ValueError("a piece reaches across a space or a line end")
        self.text_of = dict((i, p) for p, i in pieces)
        self.longest = max(len(p) for p, _ in pieces)
        self.isolated = self.model.encode("\n")  # a line end keeps what follows apart
        hashes = np.array([self._hash(p) for p, _ in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([i for _, i in pieces], np.int64)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.present = np.zeros(1 << 20, bool)
        self.present[self.hashes >> np.uint64(44)] = True
        self.pairs = np.zeros(1 << _PAIR_BITS, np.uint64)  # direct-mapped: key * 2 + answer
        self.units = new_memo()

    @staticmethod
    def _hash(text: str) -> np.uint64:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        return (mix(codes + _ONE) * _POWERS[: len(codes)]).sum(dtype=np.uint64)

    def _piece(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        found = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.present[hashes >> np.uint64(44)])
        if len(maybe):
            asked = hashes[maybe]
            at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
            same = self.hashes[at] == asked
            found[maybe[same]] = self.ids[at[same]]
        return found

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece stays a piece of its own after the one before it."""
        keys = (before * 65536 + piece).astype(np.uint64) + _ONE
        slots = (keys * _GOLD) >> np.uint64(64 - _PAIR_BITS)
        stored = self.pairs[slots]
        unknown = stored >> _ONE != keys
        answers = (stored & _ONE).astype(bool)
        if unknown.any():
            asked, where = np.unique(keys[unknown], return_inverse=True)
            left, right = np.divmod(asked.astype(np.int64) - 1, 65536)
            text_of, start = self.text_of, self.isolated
            tried = self.model.encode(["\n" + text_of[a] + text_of[b] for a, b in zip(left.tolist(), right.tolist(), strict=True)])
            apart = np.array([t == [*start, a, b] for t, a, b in zip(tried, left.tolist(), right.tolist(), strict=True)], np.uint64)
            self.pairs[(asked * _GOLD) >> np.uint64(64 - _PAIR_BITS)] = asked * np.uint64(2) + apart
            answers[unknown] = apart.astype(bool)[where]
        return answers

    def changes(self, units: list[str]) -> list[bytes]:
        """Changes of the token count, one signed byte per character, for each unit."""
        lengths = np.array([len(u) for u in units])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        joined = "".join([units[i] for i in order.tolist()])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        state = offsets[:-1] + np.arange(len(units))  # each unit has one more prefix than characters
        mixed = mix(codes + _ONE)
        counts = np.zeros(len(codes) + len(units), np.int64)
        lasts = np.full(len(codes) + len(units), _START, np.int64)
        active = len(units)
        for end in range(1, int(lengths[0]) + 1 if active else 0):
            active = int(np.searchsorted(-lengths, -end, side="right"))
            open_ = np.arange(active)
            # hashes of the substrings ending here, shortest first, then tried longest first
            partial = []
            value = np.zeros(active, np.uint64)
            for length in range(1, min(end, self.longest) + 1):
                value = value * _BASE + mixed[offsets[:active] + end - length]
                partial.append(value)
            for length in range(len(partial), 0, -1):
                piece = self._piece(partial[length - 1][open_])
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                unit, piece = open_[hit], piece[hit]
                before = lasts[state[unit] + end - length]
                good = before < 0
                rest = np.flatnonzero(~good)
                if len(rest):
                    good[rest] = self._fits(before[rest], piece[rest])
                unit = unit[good]
                place = state[unit] + end
                counts[place] = counts[place - length] + 1
                lasts[place] = piece[good]
                left = np.ones(len(open_), bool)
                left[hit[good]] = False
                open_ = open_[left]
                if not len(open_):
                    break
            if len(open_):  # characters outside the vocabulary: a token per byte, joined to nothing
                place = state[open_] + end
                code = codes[offsets[open_] + end - 1]
                counts[place] = counts[place - 1] + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                lasts[place] = _OUTSIDE
        steps = np.diff(counts)
        first = np.zeros(len(counts), bool)
        first[state[1:]] = True
        packed = steps[~first[1:]].astype(np.int8).tobytes()
        out: list[bytes] = [b""] * len(units)
        for rank, i in enumerate(order.tolist()):
            out[i] = packed[offsets[rank] : offsets[rank + 1]]
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        """Units of a text with its leading space; their characters add up to it."""
        if text[0] == " " or "  " in text or _SPACE in text or "\x01" in text:
            return _UNITS.findall(_SPACE + text.replace(" ", _SPACE))
        return (_SPACE + text.replace(" ", "\x01" + _SPACE).replace("\n", "\x01\n")).split("\x01")

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """int8 per code point of each text: change of the token count of the prefix."""
        memo = self.units
        if len(memo) > MEMO_UNITS:
            memo.clear()
        parts = [self.split(t) if t else [] for t in texts]
        new = list({u for part in parts for u in part if u not in memo})
        if new:
            memo.update(zip(new, self.changes(new), strict=True))
        out = []
        for part in parts:
            joined = np.frombuffer(b"".join([memo[u] for u in part]), np.int8)
            changes = joined[1:].copy()
            if len(changes):
                changes[0] += joined[0]  # the leading space belongs to the first character
            out.append(changes)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def longest_fit(changes: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix of at most ``limit`` tokens."""
    if len(changes) <= limit and len(changes) * 4 <= limit:
        return len(changes)
    within = np.flatnonzero(np.cumsum(changes, dtype=np.int64) <= limit)
    return int(within[-1]) + 1 if len(within) else 0


def _counted(name: str, limit: int, keep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = counter(model_path(name))
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            rows, group, chars = [], [], 0
            for i, text in enumerate(texts):
                group.append(text)
                chars += len(text)
                if chars > GROUP_CHARS or i == len(texts) - 1:
                    for whole, changes in zip(group, tables.tables(group), strict=True):
                        size = len(whole.encode("utf-8", "surrogatepass"))
                        rows.append((size, int(changes.sum(dtype=np.int64)), longest_fit(changes, limit), changes.tobytes() if keep else None))
                    group, chars = [], 0
            n_bytes, n_tokens, fit, stored = zip(*rows, strict=True) if rows else ((),) * 4
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": n_bytes, "n_tokens": n_tokens, "fit_chars": fit, "steps": stored})

    return run


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = LIMIT, keep_steps: bool = True) -> DataFrame:
    """``<id>, n_bytes, n_tokens, over_limit, fit_chars, steps`` per document.

    ``steps`` is the stored prefix table (see ``tokens_at``); ``fit_chars`` is the
    longest prefix, in code points, of at most ``limit`` tokens.
    """
    source = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = source.mapInPandas(frugal(_counted(model, limit, keep_steps)), "doc_id long, n_bytes long, n_tokens long, fit_chars long, steps binary")
    rows = rows.withColumnRenamed("doc_id", id_col).withColumn("over_limit", F.col("n_tokens") > limit)
    return rows if keep_steps else rows.drop("steps")


@F.pandas_udf(T.LongType())
def tokens_at(steps: pd.Series, chars: pd.Series) -> pd.Series:
    """Token count of the prefix of ``chars`` code points, from a stored table."""
    return pd.Series([int(np.frombuffer(s, np.int8)[:n].sum(dtype=np.int64)) for s, n in zip(steps, chars, strict=True)], dtype="int64")


@F.pandas_udf(T.LongType())
def chars_within(steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Longest prefix in code points that costs at most ``budget`` tokens."""
    return pd.Series([longest_fit(np.frombuffer(s, np.int8), int(n)) for s, n in zip(steps, budget, strict=True)], dtype="int64")
