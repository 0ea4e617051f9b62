"""Scalar helpers: clipping, softmax, intervals, frame clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def temporal_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap ratio of two half-open intervals; 0 when their union is empty."""
    shared = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0)).cast("double")
    union = (a_end - a_start) + (b_end - b_start) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def seconds(frame: Column, fps: float) -> Column:
    return frame / F.lit(float(fps))


def softmax(logits: Column) -> Column:
    """Softmax of an array of logits, shifted by its maximum."""
    peak = F.array_max(logits)
    powers = F.transform(logits, lambda v: F.exp(v - peak))
    mass = F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(powers, lambda v: v / mass)


def argmax(values: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def pair_key(a: Column, b: Column) -> Column:
    """Unordered pair as struct(i, j) with i < j."""
    return F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))
