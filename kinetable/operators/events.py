"""Event-camera accumulation and rendering on sparse cells.

The dense (frame, channel, y, x) histogram is never built: a cell exists only
where at least one event fell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.dims import SENSOR_HEIGHT, SENSOR_WIDTH
from kinetable.functions.numeric import clip
from kinetable.operators.chunks import attach_by_key

# Accepted column names per event field, in order of preference (fixed values).
FIELD_ALIASES = [
    ("t_us", ["t", "timestamp", "ts"]),
    ("x", ["x"]),
    ("y", ["y"]),
    ("p", ["p", "pol", "polarity"]),
]


def field_names(columns: list[str], where: str = "") -> dict[str, str]:
    """The column that holds each event field: the first accepted name that is there."""
    found = {}
    for field, names in FIELD_ALIASES:
        there = [n for n in (*names, field) if n in columns]
        if not there:
            raise ValueError(f"{where}no {names[0]!r} column among {list(columns)}")
        found[field] = there[0]
    return found


def resolve_fields(df: DataFrame, key: str = "segment") -> DataFrame:
    """Tabular events with any accepted column names -> (key, t_us, x, y, p)."""
    picked = field_names(df.columns)
    return df.select(key, *[F.col(name).cast("double").alias(field) for field, name in picked.items()])


def to_sensor(df: DataFrame, height: int = SENSOR_HEIGHT, width: int = SENSOR_WIDTH) -> DataFrame:
    """Truncate coordinates toward zero, clip them to the sensor; non-positive polarity is OFF."""
    return df.withColumns(
        {
            "x": clip(F.col("x").cast("bigint"), 0, width - 1).cast("int"),
            "y": clip(F.col("y").cast("bigint"), 0, height - 1).cast("int"),
            "channel": (F.col("p") <= 0).cast("int"),
        }
    )


def accumulate(
    events: DataFrame,
    window_ms: float = 33.0,
    height: int = SENSOR_HEIGHT,
    width: int = SENSOR_WIDTH,
    key: str = "segment",
) -> DataFrame:
    """Count events per (key, frame, channel, y, x); windows start at the key's first event."""
    facts = events.groupBy(key).agg(F.min("t_us").alias("t0"), F.count("*").alias("weight"))
    placed = attach_by_key(events, facts, key, "weight", ["t_us", "x", "y"])
    framed = placed.withColumn(
        "frame", F.floor((F.col("t_us") - F.col("t0")) / F.lit(window_ms * 1000.0)).cast("int")
    )
    return (
        to_sensor(framed, height, width)
        .groupBy(key, "frame", "channel", "y", "x")
        .agg(F.count("*").alias("n"))
    )


def render_scale(cells: DataFrame, key: str = "segment") -> DataFrame:
    """Per key the brightness scale: 99th percentile of the non-zero cells, at least 1.

    Cells are first counted per value, so the percentile state holds distinct counts only.
    """
    values = cells.groupBy(key, "n").agg(F.count("*").alias("cells"))
    return values.groupBy(key).agg(
        F.greatest(F.expr("percentile(n, 0.99D, cells)"), F.lit(1.0)).alias("scale"),
        F.sum("cells").alias("cells"),
    )


def render(cells: DataFrame, key: str = "segment") -> DataFrame:
    """Sparse pixels (key, frame, y, x, r, b) with 8-bit values: ON is red, OFF is blue."""
    scaled = attach_by_key(cells, render_scale(cells, key), key, "cells", ["frame", "y", "x"])
    level = F.floor(F.least(F.col("n") / F.col("scale") * 255.0, F.lit(255.0))).cast("int")
    return (
        scaled.withColumn("level", level)
        .groupBy(key, "frame", "y", "x")
        .agg(
            F.coalesce(F.max(F.when(F.col("channel") == 0, F.col("level"))), F.lit(0)).alias("r"),
            F.coalesce(F.max(F.when(F.col("channel") == 1, F.col("level"))), F.lit(0)).alias("b"),
        )
    )
