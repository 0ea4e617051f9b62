"""Per-key scans over a stream whose rows come in any order.

Each key has its own progress: a row may lag up to ``disorder`` behind the newest row of its key.
Rows wait in the key's state until nothing before them can come any more and are then handed to
the scan in order, so clips that start late, files in any order and micro-batches cut anywhere give
the result of one pass over the sorted clip. A row behind what its key has handed on is late: it is
put out as such, not dropped. A timer closes a key: at the end of the stream (:func:`run.ending`),
or after ``idle`` without rows. What a closed key kept is cleared.

State per key: the rows of the last ``disorder`` frames, the scan's carry and two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows stand at this event time, so the watermark moves only when the stream ends.
CLOCK, NOW, PATIENCE = "clock", "2000-01-01", "1 day"
#: Keys are closed when the watermark passes this time (milliseconds).
CLOSES = 978_307_200_000
STATE = "top bigint, done bigint, orders array<bigint>, values array<double>, carry array<double>"


class Scan(Protocol):
    """What an operator does with the ordered rows of one key."""

    #: Result columns besides the key.
    schema: str

    def run(self, carry: list[float], orders: np.ndarray, values: np.ndarray, closing: bool) -> tuple[list[float], pd.DataFrame]:
        """The next carry and the results of rows that follow all earlier ones; ``carry`` is empty at first."""


class Ordered(StatefulProcessor):
    """Sorts the rows of a key within its disorder and feeds them to a scan."""

    def __init__(self, scan: Scan, keys: list[str], order: str, width: int, disorder: int, idle_ms: int | None):
        self.scan, self.keys, self.order = scan, keys, order
        self.width, self.disorder, self.idle_ms = width, disorder, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("key", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [part[part[self.order].notna()] for part in rows]
        parts = [part for part in parts if len(part)]
        if not parts:
            return
        known = self.state.exists()
        top, done, orders, values, carry = self._load() if known else (-(1 << 62), -(1 << 62), [], [], [])
        here = np.concatenate([part[self.order].to_numpy(np.int64) for part in parts])
        with_ = np.concatenate([np.stack(part["payload"].to_numpy()) for part in parts]).astype(float)
        late = here <= done
        if late.any():
            yield self._rows(key, pd.DataFrame({self.order: here[late]}), True)
        orders = np.concatenate([orders, here[~late]]).astype(np.int64)
        values = np.concatenate([np.reshape(values, (-1, self.width)), with_[~late]])
        top = max(top, int(here.max()))
        done = max(done, top - self.disorder)
        ready = orders <= done
        if ready.any():
            carry, found = self._scan(carry, orders[ready], values[ready], False)
            if len(found):
                yield self._rows(key, found, False)
        self.state.update((top, done, orders[~ready].tolist(), values[~ready].ravel().tolist(), [float(x) for x in carry]))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        elif not known:
            self.handle.registerTimer(CLOSES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        _, _, orders, values, carry = self._load()
        self.state.clear()
        _, found = self._scan(carry, np.array(orders, np.int64), np.reshape(values, (-1, self.width)), True)
        if len(found):
            yield self._rows(key, found, False)

    def close(self) -> None:
        pass

    def _load(self) -> tuple:
        top, done, orders, values, carry = self.state.get()
        return top, done, list(orders), list(values), list(carry)

    def _scan(self, carry, orders, values, closing) -> tuple[list[float], pd.DataFrame]:
        # Rows of one order stand by their first value.
        place = np.lexsort((values[:, 0], orders))
        return self.scan.run(carry, orders[place], values[place], closing)

    def _rows(self, key, found: pd.DataFrame, late: bool) -> pd.DataFrame:
        names = [f.split()[0] for f in self.scan.schema.split(", ")]
        out = found.reindex(columns=names)
        for i, name in enumerate(self.keys):
            out.insert(i, name, key[i])
        return out.assign(late=late)


def scan(
    rows: DataFrame, by: Scan, keys: list[str], order: str, values: list, disorder: int, idle: str | None = None
) -> DataFrame:
    """Results of a scan over each key's rows in ``order``, with a column ``late``.

    ``values`` are the double columns that the scan reads; a late row has its key and order alone.
    """
    if CLOCK not in rows.columns:
        rows = timeless(rows)
    packed = F.array(*[F.col(v).cast("double") if isinstance(v, str) else v for v in values])
    fed = rows.withWatermark(CLOCK, PATIENCE).select(*keys, CLOCK, F.col(order).cast("bigint").alias(order), packed.alias("payload"))
    kinds = {k: rows.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join([*(f"{k} {kind}" for k, kind in kinds.items()), by.schema, "late boolean"])
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    return fed.groupBy(*keys).transformWithStateInPandas(
        Ordered(by, keys, order, len(values), disorder, idle_ms), schema, "Append", "ProcessingTime" if idle else "EventTime"
    )


def timeless(stream: DataFrame) -> DataFrame:
    """The stream with an event time that stands still, for :func:`run.ending`."""
    return stream.withColumn(CLOCK, F.lit(NOW).cast("timestamp"))
