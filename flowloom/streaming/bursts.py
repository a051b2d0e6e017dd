"""Gap splitting of flows on a stream, with state of its own."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowloom.operators.flows import FLOW_KEY

# transformWithState keeps its state in RocksDB
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "open"
_OPEN = T.StructType([T.StructField(c, T.LongType()) for c in ("first_us", "last_us", "n_packets", "n_bytes")])


def merge_bursts(bursts: np.ndarray, gap: int) -> np.ndarray:
    """Rows ``first, last, packets, bytes`` in order of time, those less than ``gap`` apart joined."""
    bursts = bursts[np.argsort(bursts[:, 0], kind="stable")]
    reached = np.maximum.accumulate(bursts[:, 1])
    starts = np.flatnonzero(np.concatenate(([True], bursts[1:, 0] - reached[:-1] >= gap)))
    return np.column_stack(
        (
            bursts[starts, 0],
            np.maximum.reduceat(bursts[:, 1], starts),
            np.add.reduceat(bursts[:, 2], starts),
            np.add.reduceat(bursts[:, 3], starts),
        )
    )


class OpenBursts(StatefulProcessor):
    """The bursts of a key that may still grow, and a timer for the first of them to close.

    A row joins every burst it is less than ``gap`` away from, whatever the order in
    which rows arrive. Once the watermark is a gap past a burst's end no row can reach
    it, and it is emitted. A key holds at most one burst per gap of the allowed lateness,
    and one more.
    """

    def __init__(self, gap: int, keys: Sequence[str]):
        self.gap = gap
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState(_STATE, _OPEN)

    def _held(self) -> np.ndarray:
        rows = [tuple(row) for row in self.open.get()] if self.open.exists() else []
        return np.array(rows, np.int64).reshape(-1, 4)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [self._held()]
        for batch in rows:
            at = batch["at_us"].to_numpy(np.int64)
            parts.append(np.column_stack((at, at, batch["n"].to_numpy(np.int64), batch["bytes"].to_numpy(np.int64))))
        self._keep(merge_bursts(np.concatenate(parts), self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        # rows still to come are later than the watermark
        done = held[:, 1] + self.gap <= timerValues.getCurrentWatermarkInMs() * 1000 + 1
        self._keep(held[~done])
        if done.any():
            yield self._rows(key, held[done])

    def _keep(self, bursts: np.ndarray) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not len(bursts):
            self.open.clear()
            return
        self.open.put([tuple(map(int, row)) for row in bursts])
        self.handle.registerTimer(int(-(-(bursts[0, 1] + self.gap) // 1000)))

    def _rows(self, key, bursts: np.ndarray) -> pd.DataFrame:
        named = {c: [v] * len(bursts) for c, v in zip(self.keys, key, strict=True)}
        return pd.DataFrame({**named, **{c: bursts[:, i] for i, c in enumerate(_OPEN.names)}})

    def close(self) -> None:
        pass


def _summary(bursts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bursts.select(
        *keys,
        "n_packets",
        "n_bytes",
        F.timestamp_micros("first_us").alias("first_ts"),
        F.timestamp_micros("last_us").alias("last_ts"),
    )


def stream_bursts(
    packets: DataFrame,
    gap_seconds: float,
    late: str = "10 seconds",
    keys: Sequence[str] = tuple(FLOW_KEY),
) -> DataFrame:
    """Bursts of every key, emitted once the watermark has passed their end by the gap.

    Rows up to ``late`` behind the latest time seen are taken in, in any order; later
    ones are dropped and counted (``numRowsDroppedByWatermark``). A gap of exactly
    ``gap_seconds`` starts a new burst, as in `split_at_gaps`. Rows without a time or a
    length join no burst or add no bytes. Bursts the watermark has not closed when the
    stream ends are in its state: `open_bursts`.
    """
    keys = list(keys)
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    rows = packets.where("ts is not null").withWatermark("ts", late)
    slim = rows.select(
        *keys,
        "ts",
        F.unix_micros("ts").alias("at_us"),
        F.lit(1).cast("long").alias("n"),
        F.coalesce(F.col("frame_len").cast("long"), F.lit(0)).alias("bytes"),
    )
    out = T.StructType([*[packets.schema[c] for c in keys], *_OPEN.fields])
    bursts = slim.groupBy(*keys).transformWithStateInPandas(
        OpenBursts(int(gap_seconds * 1_000_000), keys), out, "Append", "EventTime"
    )
    return _summary(bursts, keys)


def open_bursts(spark: SparkSession, checkpoint: str, keys: Sequence[str] = tuple(FLOW_KEY)) -> DataFrame:
    """Bursts in the state of a stream at its last batch; no packet is read again.

    With what the stream has emitted, every burst is there once. The state is left as it
    is, so a stream restarted from the checkpoint goes on with these bursts.
    """
    state = (
        spark.read.format("statestore")
        .option("stateVarName", _STATE)
        .load(checkpoint)
        .select(*[F.col("key")[c].alias(c) for c in keys], "list_element.*")
    )
    return _summary(state, keys)
