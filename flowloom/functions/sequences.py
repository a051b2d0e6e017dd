"""Fixed-length and token forms of packet sequences held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.profiles import MTU


def shift_tokens(seq: Column, limit: int = MTU) -> Column:
    """[-limit, limit] to [1, 2*limit + 1]."""
    return F.transform(seq, lambda v: v + (limit + 1))


def shift_tokens_keep_zero(seq: Column, limit: int = MTU) -> Column:
    """As `shift_tokens`, but a 0 stays the padding token."""
    return F.transform(seq, lambda v: F.when(v == 0, F.lit(0)).otherwise(v + (limit + 1)))


def unsigned_tokens(seq: Column, limit: int | None = None, min_length: int = 0) -> Column:
    """|v|, optionally capped at ``limit`` and zero-padded to ``min_length``."""
    if limit is None:
        tokens = F.transform(seq, F.abs)
    else:
        tokens = F.transform(seq, lambda v: F.least(F.abs(v), F.lit(limit)))
    if min_length:
        missing = F.greatest(F.lit(min_length) - F.size(seq), F.lit(0))
        tokens = F.concat(tokens, F.array_repeat(F.lit(0), missing))
    return tokens


def folded_tokens(seq: Column, limit: int = MTU) -> Column:
    """Negative lengths to |v|, the others to v + limit + 1."""
    return F.transform(seq, lambda v: F.when(v < 0, -v).otherwise(v + (limit + 1)))


def directions(seq: Column) -> Column:
    return F.transform(seq, lambda v: F.signum(v).cast("int"))


def fixed_length(seq: Column, length: int | Column) -> Column:
    """Cut or zero-pad at the end to exactly ``length`` values."""
    target = F.lit(length) if isinstance(length, int) else length
    missing = F.greatest(target - F.size(seq), F.lit(0)).cast("int")
    return F.concat(F.slice(seq, F.lit(1), target.cast("int")), F.array_repeat(F.lit(0), missing))


def ordered_values(packed: Column) -> Column:
    """Values of an array of (order, value) structs, in order.

    `collect_list` gives no order after a shuffle, so sequences are always
    collected with their position and sorted here.
    """
    return F.transform(F.sort_array(packed), lambda s: s["v"])


def joined(seq: Column) -> Column:
    return F.array_join(F.transform(seq, lambda v: v.cast("string")), ",")
