"""Padded batches from an unbounded stream of pieces.

Keyed by model and a producer's shard, so one busy model is many keys. A batch
goes out when it is full, when one more row would pass the padding cap, or when
its window closes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxloom.operators.batching import MAX_PADDED, MAX_ROWS

OUT = "model string, shard long, batch long, ord long, n long, closed string"


class Packer(StatefulProcessor):
    """Holds a key's open batch, at most `max_rows` pieces."""

    def __init__(self, max_rows: int, max_padded: int, window_ms: int):
        self.max_rows, self.max_padded, self.window_ms = max_rows, max_padded, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "ord long, n long")
        self.count = handle.getValueState("count", "batch long")

    def _number(self) -> int:
        return self.count.get()[0] if self.count.exists() else 0

    def _emit(self, key, rows: list, why: str) -> pd.DataFrame:
        batch = self._number()
        self.count.update((batch + 1,))
        return pd.DataFrame(
            {"model": key[0], "shard": key[1], "batch": batch, "ord": [r[0] for r in rows], "n": [r[1] for r in rows], "closed": why}
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        waiting = bool(held)
        for frame in rows:
            for piece in frame.sort_values("ord")[["ord", "n"]].itertuples(index=False):
                row = (int(piece.ord), int(piece.n))
                longest = max([r[1] for r in held] + [row[1]])
                if held and (len(held) + 1) * longest > self.max_padded:
                    yield self._emit(key, held, "padding")
                    held, waiting = [], False
                held.append(row)
                if len(held) >= self.max_rows:
                    yield self._emit(key, held, "full")
                    held, waiting = [], False
        if held:
            self.open.put(held)
            if not waiting:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.window_ms)
        else:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        if held:
            self.open.clear()
            yield self._emit(key, held, "window")

    def close(self) -> None:
        pass


def micro_batch_stream(
    pieces: DataFrame, *, max_rows: int = MAX_ROWS, max_padded: int = MAX_PADDED, window_ms: int = 4
) -> DataFrame:
    """A stream of pieces(model, shard, ord, n) to their batches. Needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return pieces.groupBy("model", "shard").transformWithStateInPandas(
        statefulProcessor=Packer(max_rows, max_padded, window_ms), outputStructType=OUT, outputMode="append", timeMode="ProcessingTime"
    )
