"""Sharding by a Feistel permutation of the global row numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import numbered

ROUNDS = 6


def _keys(seed: int) -> list[int]:
    """One 64-bit key per round, by splitmix64 from the seed."""
    keys, state = [], seed & (2**64 - 1)
    for _ in range(ROUNDS):
        state = (state + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        keys.append(z ^ (z >> 31))
    return keys


def _half_bits(count: int) -> int:
    return max(1, math.ceil(max(count - 1, 1).bit_length() / 2))


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    z = half ^ np.uint64(key)
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (z ^ (z >> np.uint64(33))) & mask


def permute(rows: np.ndarray, count: int, seed: int, back: bool = False) -> np.ndarray:
    """Place of each row number under the permutation of 0..count-1, or with ``back`` its inverse.

    The network permutes the next even power of two; a value outside the range walks on along
    its cycle until it is inside, which keeps the whole a permutation of the range.
    """
    bits = np.uint64(_half_bits(count))
    mask = np.uint64((1 << int(bits)) - 1)
    keys = _keys(seed)[:: -1 if back else 1]
    out = rows.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> bits, out[todo] & mask
            for key in keys:
                if back:
                    left, right = right ^ _round(left, key, mask), left
                else:
                    left, right = right, left ^ _round(right, key, mask)
            out[todo] = (left << bits) | right
            todo = todo[out[todo] >= np.uint64(count)]
    return out.astype(np.int64)


def place(row_no: Column, count: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def placed(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), count, seed))

    return placed(row_no)


def row_at(shard: int, slot: int, count: int, shards: int, seed: int) -> int:
    """The row number that stands in a slot of a shard: the layout can be read both ways."""
    return int(permute(np.array([slot * shards + shard]), count, seed, back=True)[0])


def shard_rows(docs: DataFrame, order: list[Column], shards: int = 16, seed: int = 42) -> DataFrame:
    """Adds ``shard`` and ``slot``: the permuted row number modulo and divided by the shard count.

    Rows are numbered in the given order. Shard sizes differ by one at most and slots have no
    gaps, for any distribution of keys; copies, nulls and empty texts are rows like any other.
    Rows that tie in ``order`` are exchangeable. Other columns are kept, a ``shard`` or ``slot``
    among them is replaced.
    """
    rows = numbered(docs.drop("shard", "slot"), order, "shards", "_shard_row")
    count = rows.count()
    spot = place(F.col("_shard_row"), max(count, 1), seed)
    return (
        rows.withColumn("_spot", spot)
        .withColumn("shard", (F.col("_spot") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_spot div {shards}"))
        .drop("_spot", "_shard_row")
    )
