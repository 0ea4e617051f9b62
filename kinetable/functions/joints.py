"""Expressions over the 17-joint array of one skeleton. All stay inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _num(col: Column) -> Column:
    return col.cast("double")


def visible(joints: Column) -> Column:
    """Joints with a positive score."""
    return F.filter(joints, lambda j: j.s > 0)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + _num(v))


def array_sum_square(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + _num(v) * _num(v))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def shared_steps(current: Column, previous: Column) -> Column:
    """Displacements of the joints visible in both skeletons."""
    moves = F.zip_with(
        current,
        previous,
        lambda c, p: F.when(
            (c.s > 0) & (p.s > 0), distance(_num(c.x), _num(c.y), _num(p.x), _num(p.y))
        ),
    )
    return F.filter(moves, lambda d: d.isNotNull())


def double_joints(joints: Column) -> Column:
    return F.transform(
        joints,
        lambda j: F.struct(
            _num(j.x).alias("x"), _num(j.y).alias("y"), _num(j.s).alias("s")
        ),
    )


def median_of(values: Column) -> Column:
    """Interpolated median of a non-empty numeric array."""
    ordered = F.sort_array(values)
    size = F.size(values)
    low = F.floor((size - 1) / F.lit(2)).cast("int")
    high = F.floor(size / F.lit(2)).cast("int")
    return F.when(size > 0, (ordered[low] + ordered[high]) / 2.0)
