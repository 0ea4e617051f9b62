"""Stateful stream operators: slot tracking, motion, trailing-median spikes.

Rows may come in any order within ``disorder`` frames of their key, a frame may be spread over
micro-batches, and each clip has its own progress (:mod:`kinetable.streaming.ordered`). The batch
operators are the twins. Results have a column ``late``: true for a row that came behind what its
key had put out, which has no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.dims import NUM_JOINTS
from kinetable.operators.batches import equal_runs
from kinetable.operators.signals import MIN_MOTION_HEIGHT
from kinetable.operators.tracking import advance
from kinetable.streaming.ordered import scan

#: Frames that a row may lag behind the newest one of its key.
DISORDER = 64


class Slots:
    """Detections to slots; carries the slots' centroids."""

    schema = "frame bigint, rank int, person int"

    def __init__(self, max_persons: int):
        self.max_persons = max_persons

    def run(self, carry, orders, values, closing):
        slots = np.array(carry, float).reshape(-1, 2) if carry else np.full((self.max_persons, 2), np.nan)
        given = np.empty(len(orders), np.int32)
        for low, high in equal_runs(orders):
            given[low:high], _ = advance(values[low:high, 1:3], values[low:high, 3:], slots)
        return slots.ravel().tolist(), pd.DataFrame({"frame": orders, "rank": values[:, 0].astype(np.int32), "person": given})


class Motion:
    """Displacement since the frame before; carries the last skeleton with its frame."""

    schema = "frame bigint, motion double"

    def __init__(self, min_joints: int):
        self.min_joints = min_joints

    def run(self, carry, orders, values, closing):
        points = values.reshape(-1, NUM_JOINTS, 3)
        before, first = (int(carry[0]), np.reshape(carry[1:], (1, NUM_JOINTS, 3))) if carry else (-2, np.zeros((1, NUM_JOINTS, 3)))
        previous = np.concatenate([first, points[:-1]])[: len(points)]
        linked = orders == np.concatenate([[before], orders[:-1]])[: len(orders)] + 1
        both = (points[..., 2] > 0) & (previous[..., 2] > 0) & linked[:, None]
        gaps = np.linalg.norm(points[..., :2] - previous[..., :2], axis=2)
        count = both.sum(axis=1)
        seen = points[..., 2] > 0
        top = np.where(seen, points[..., 1], -np.inf).max(axis=1)
        low = np.where(seen, points[..., 1], np.inf).min(axis=1)
        height = np.maximum(top - low, MIN_MOTION_HEIGHT)
        mean = (gaps * both).sum(axis=1) / np.maximum(count, 1)
        found = np.where(count >= self.min_joints, mean / height, 0.0)
        carry = [float(orders[-1]), *values[-1]] if len(orders) else carry
        return carry, pd.DataFrame({"frame": orders, "motion": found})


class Spikes:
    """Rise above the trailing median; carries the last values."""

    schema = "frame bigint, spike double"

    def __init__(self, baseline: int):
        self.baseline = baseline

    def run(self, carry, orders, values, closing):
        series = pd.Series([*carry, *values[:, 0]], dtype=float)
        median = series.rolling(self.baseline + 1, min_periods=1).median().to_numpy()[len(carry) :]
        return series.tail(self.baseline).tolist(), pd.DataFrame({"frame": orders, "spike": np.maximum(values[:, 0] - median, 0.0)})


def _ints(df: DataFrame) -> DataFrame:
    return df.withColumn("frame", F.col("frame").cast("int"))


def track_slots(centroids: DataFrame, max_persons: int = 2, key: str = "clip_id", disorder: int = DISORDER, idle: str | None = None) -> DataFrame:
    """(key, frame, rank, person, late): detections to slots, remembering slot centroids."""
    return _ints(scan(centroids, Slots(max_persons), [key], "frame", ["rank", "cx", "cy", "vx", "vy"], disorder, idle))


def motion(poses: DataFrame, min_joints: int = 3, key: str = "clip_id", disorder: int = DISORDER, idle: str | None = None) -> DataFrame:
    """(key, person, frame, motion, late): displacement since the previous frame of the person."""
    points = [F.col("joints")[j][axis].cast("double") for j in range(NUM_JOINTS) for axis in ("x", "y", "s")]
    return _ints(scan(poses, Motion(min_joints), [key, "person"], "frame", points, disorder, idle))


def spikes(
    values: DataFrame, baseline: int, value: str = "score", key: str = "clip_id", disorder: int = DISORDER, idle: str | None = None
) -> DataFrame:
    """(key, frame, spike, late): rise above the median of this and the ``baseline`` previous values."""
    return _ints(scan(values, Spikes(baseline), [key], "frame", [value], disorder, idle))
