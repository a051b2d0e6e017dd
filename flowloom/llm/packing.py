"""Best-fit packing of token sequences under several capacities at once.

A document is its token ids and an end id; documents longer than a sequence are cut so
that only the first piece may be short. An item's demand depends on its length alone:
tokens, one document, and attention cost length**2. So items of one length are
interchangeable, and the plan is made for (length, count) pairs, of which there are at
most ``capacity`` whatever the corpus holds:

* lengths go from long to short; among the open bins in which every capacity suffices,
  the one with the smallest weighted norm of what would be left (``norm``), or with the
  largest weighted dot-product of demand and residual (``dot``), takes the next item;
* bins with the same content are one entry with a count, so all corpora of the same
  length histogram cost the same; both rules are planned and the one with fewer bins
  is used.

The pieces themselves never meet on one machine: each gets its rank within its length
(ranks inside hashed buckets plus bucket offsets), and the plan maps (length, rank) to
sequence and offset. The plan and its lookup are bounded by the number of lengths.

Defined cases: null or empty text is the end id alone (one token); repeated rows are
packed once per row; a null id is carried along; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowloom.llm.common import frugal, new_memo, stage, whole_texts

CAPACITY, END_ID = 1024, 2
MAX_DOCUMENTS = 1024
MAX_COST = 1024 * 1024
WEIGHTS = (1.0, 0.1, 0.3)
BUCKET_ROWS = 50_000
MEMO_UNITS = 250_000
GROUP_DOCUMENTS = 500
# characters for which the two tokenizer libraries were compared; other texts are
# encoded by the slower one, which is the definition
_PLAIN = re.compile("[\n\x20-\x7e\xa1-\xac\xae-ɏ–—‘’“”…€]*")
# the same for UTF-8 bytes of ASCII and U+00C0 to U+024F, which is quicker to look at
_PLAIN_BYTES = bytes([0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
_SPECIAL = "<|endoftext|>"


def is_plain(text: str) -> bool:
    rest = text.encode("utf-8", "surrogatepass").translate(None, _PLAIN_BYTES)
    return (not rest or _PLAIN.fullmatch(text) is not None) and _SPECIAL not in text


class Encoder:
    """Byte-level BPE ids as little-endian uint32 bytes, by words seen before."""

    def __init__(self, vocabulary: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import base64

        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(vocabulary)
        with open(public_tokenizers.path(ranks), "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.sizes = np.zeros(max(merges.values()) + 1, np.int64)  # bytes of each id
        for piece, i in merges.items():
            self.sizes[i] = len(piece)
        self.units = new_memo()

    @cached_property
    def whole(self):
        """The defining tokenizer; large, so it is loaded by the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(text) for text in texts]
        memo = self.units
        if len(memo) > MEMO_UNITS:
            memo.clear()
        self.learn({u for part in parts if part is not None for u in part if u not in memo})
        return [self.encode_alone(t) if part is None else b"".join([memo[u] for u in part]) for t, part in zip(texts, parts, strict=True)]

    @staticmethod
    def split(text: str) -> list[str] | None:
        """Units that encode alone: single spaces start one, single line ends are one."""
        if not is_plain(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return None
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def encode_alone(self, text: str) -> bytes:
        if not is_plain(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def learn(self, units: set[str]) -> None:
        """Ids of new units; those that start with a space are encoded in one call and
        taken apart by the bytes that each id stands for."""
        memo, spaced = self.units, []
        memo[""] = b""
        for unit in units:
            if len(unit) > 1 and unit[0] == " ":
                spaced.append(unit)
            else:
                memo[unit] = array("I", self.fast.encode_ordinary(unit)).tobytes()
        ids = np.array(self.fast.encode_ordinary("".join(spaced)), np.uint32)
        ends = np.cumsum(self.sizes[ids])
        bounds = np.searchsorted(ends, np.cumsum([len(u.encode()) for u in spaced])) + 1
        packed, before = ids.tobytes(), 0
        for unit, bound in zip(spaced, bounds.tolist(), strict=True):
            memo[unit] = packed[4 * before : 4 * bound]
            before = bound


@lru_cache(maxsize=2)
def encoder(vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> Encoder:
    return Encoder(vocabulary, ranks)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole sequences, the first one what is over."""
    first = total % capacity or capacity
    starts = [0, *range(first, total, capacity)]
    return [(s, first if s == 0 else capacity) for s in starts]


def _pieces(capacity: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder().encode_all
        for batch in batches:
            rows = []
            for at in range(0, len(batch), GROUP_DOCUMENTS):
                group = batch.iloc[at : at + GROUP_DOCUMENTS]
                for doc_id, ids in zip(group["doc_id"], encode([t or "" for t in group["text"]]), strict=True):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return run


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_cost: int = MAX_COST, rule: str = "norm", weights=WEIGHTS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for ``counts`` items per length: (number of bins, [(length, items each)])."""
    limits = np.array([capacity, max_documents, max_cost], np.int64)
    scale = 1.0 / limits
    weight = np.array(weights)
    room = np.zeros((256, 3), np.int64)
    number = np.zeros(256, np.int64)
    content: list[tuple] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        demand = np.array([length, 1, length * length], np.int64)
        per_bin = int((limits // demand).min())
        if per_bin < 1:
            raise ValueError(f"an item of length {length} fits no bin")
        while left:
            size = len(content)
            fits = np.flatnonzero((room[:size] >= demand).all(1) & (number[:size] > 0))
            if len(fits):
                if rule == "norm":
                    after = (room[fits] - demand) * scale
                    best = int(fits[np.argmin((weight * after * after).sum(1))])
                else:
                    best = int(fits[np.argmax((weight * (room[fits] * scale) * (demand * scale)).sum(1))])
                take = int(min(left, number[best]))
                new = [(take, room[best] - demand, (content[best], length, 1))]
                number[best] -= take
            else:
                each = min(per_bin, left)
                take = left // each * each
                new = [(take // each, limits - demand * each, (None, length, each))]
            left -= take
            for bins, free, inside in new:
                if len(content) == len(number):
                    room = np.concatenate([room, np.zeros_like(room)])
                    number = np.concatenate([number, np.zeros_like(number)])
                room[len(content)], number[len(content)] = free, bins
                content.append(inside)
    plan = []
    for bins, inside in zip(number[: len(content)].tolist(), content, strict=True):
        if bins:
            items: dict[int, int] = {}
            while inside is not None:
                inside, length, each = inside
                items[length] = items.get(length, 0) + each
            plan.append((bins, sorted(items.items(), reverse=True)))
    return plan


def segments(plan: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """Where the items of a plan lie: for each stretch of ranks of a length, the first
    sequence, the items per sequence and the offset of the first of them."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for bins, items in plan:
        offset = 0
        for length, each in items:
            rows.append((length, used.get(length, 0), each, base, offset))
            used[length] = used.get(length, 0) + bins * each
            offset += length * each
        base += bins
    return pd.DataFrame(rows, columns=["length", "rank", "each", "base", "offset"])


def _placed(table: pd.DataFrame):
    table = table.sort_values(["length", "rank"], kind="stable")
    keys = (table["length"].to_numpy(np.int64) << 44) + table["rank"].to_numpy(np.int64)
    rank, each, base, offset = (table[c].to_numpy(np.int64) for c in ("rank", "each", "base", "offset"))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, position: pd.Series) -> pd.DataFrame:
        length, position = length.to_numpy(np.int64), position.to_numpy(np.int64)
        at = np.searchsorted(keys, (length << 44) + position, side="right") - 1
        step = position - rank[at]
        return pd.DataFrame({"sequence_id": base[at] + step // each[at], "offset": offset[at] + step % each[at] * length})

    return place


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_cost: int = MAX_COST, weights=WEIGHTS) -> DataFrame:
    """``pieces`` (staged; with doc_id, piece, length, ids_crc32) plus sequence_id, offset."""
    total = pieces.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    filled = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_rows"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets, _ = stage(filled.withColumn("_before", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))), "offsets")
    counts = {row["length"]: row["n"] for row in offsets.groupBy("length").agg(F.sum("_rows").alias("n")).collect()}
    plans = [plan_bins(counts, capacity, max_documents, max_cost, rule, weights) for rule in ("norm", "dot")]
    plan = min(plans, key=lambda p: sum(bins for bins, _ in p))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_row", F.row_number().over(order)).join(offsets.drop("_rows"), ["length", "_bucket"])
    place = _placed(segments(plan))
    put = ranked.withColumn("_at", place(F.col("length"), F.col("_before") + F.col("_row") - 1))
    return put.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_cost: int = MAX_COST) -> DataFrame:
    """``<id>, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    source = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces, _ = stage(source.mapInPandas(frugal(_pieces(capacity, END_ID)), kinds), "pieces")
    return pack_pieces(pieces, capacity, max_documents, max_cost).withColumnRenamed("doc_id", id_col)
