"""Event accumulation and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog.adapters import SENSOR_EVENTS, sensor_events
from kinetable.catalog.registry import query, r6, with_tables
from kinetable.operators import events as ev

DAY_MS = 86_400_000.0
H, W = 12, 16

CELLS = """
cells AS (
  SELECT segment, cast(trunc((t_us - t0) / 86400000000.0) AS int) AS frame,
         CASE WHEN p <= 0 THEN 1 ELSE 0 END AS channel,
         cast(least(greatest(trunc(y), 0), 11) AS int) AS y,
         cast(least(greatest(trunc(x), 0), 15) AS int) AS x, count(*) AS n
  FROM (SELECT *, min(t_us) OVER (PARTITION BY segment) AS t0 FROM sensor) GROUP BY ALL)"""

SCALES = """
scales AS (SELECT segment, greatest(quantile_cont(n, 0.99), 1.0) AS scale, count(*) AS cells
           FROM cells GROUP BY 1)"""


def _cells(spark, sf):
    return ev.accumulate(sensor_events(spark, sf), DAY_MS, H, W)


@query("event_accumulate", with_tables(SENSOR_EVENTS, CELLS) + "SELECT * FROM cells")
def event_accumulate(spark, sf):
    return _cells(spark, sf)


@query(
    "event_render_scale",
    with_tables(SENSOR_EVENTS, CELLS, SCALES) + "SELECT segment, round(scale, 6) AS scale, cells FROM scales",
)
def event_render_scale(spark, sf):
    return ev.render_scale(_cells(spark, sf)).select("segment", r6("scale"), "cells")


@query(
    "event_render",
    with_tables(SENSOR_EVENTS, CELLS, SCALES)
    + """, lit AS (SELECT c.*, cast(trunc(least(n/scale*255.0, 255.0)) AS int) AS v FROM cells c JOIN scales USING (segment))
    SELECT segment, frame, y, x, coalesce(max(v) FILTER (channel = 0), 0) AS r,
           coalesce(max(v) FILTER (channel = 1), 0) AS b FROM lit GROUP BY 1, 2, 3, 4""",
)
def event_render(spark, sf):
    return ev.render(_cells(spark, sf))


@query(
    "event_frame_totals",
    with_tables(SENSOR_EVENTS, CELLS)
    + """SELECT segment, frame, cast(coalesce(sum(n) FILTER (channel = 0), 0) AS bigint) AS on_events,
         cast(coalesce(sum(n) FILTER (channel = 1), 0) AS bigint) AS off_events FROM cells GROUP BY 1, 2""",
)
def event_frame_totals(spark, sf):
    return (
        _cells(spark, sf)
        .groupBy("segment", "frame")
        .agg(
            F.sum(F.when(F.col("channel") == 0, F.col("n")).otherwise(0)).alias("on_events"),
            F.sum(F.when(F.col("channel") == 1, F.col("n")).otherwise(0)).alias("off_events"),
        )
    )
