"""Streaming operators run to the end of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.catalog.adapters import (
    SCORE_STREAMS,
    VECTOR_JOINTS,
    score_streams,
    table,
    vector_poses,
)
from kinetable.catalog.ingest_queries import TRACKED, detections
from kinetable.catalog.registry import query, r6, with_tables
from kinetable.catalog.signal_queries import BASELINE, MOTION
from kinetable.operators import tracking
from kinetable.session import materialize, scratch_path
from kinetable.streaming import run, stateful
from kinetable.streaming import windows as live


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return run.read_stream(spark, sf, schema, glob="events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


PARTS = 4


def _unordered_stream(df: DataFrame, label: str, frames: int) -> DataFrame:
    """A derived table as a stream of four micro-batches whose frames come in no order.

    A part holds ``frames`` frames of every clip and every fifth row of the part before.
    """
    path = scratch_path(df.sparkSession, label)
    late = F.when(F.col("frame") % 5 == 2, 1).otherwise(0)
    parts = df.withColumn("_part", F.least(F.expr(f"frame div {frames}") + late, F.lit(PARTS - 1)))
    stored = materialize(parts, label, "_part")
    for number in range(PARTS):  # one after the other, so that the stream reads them in this order
        part = stored.filter(F.col("_part") == number).drop("_part")
        part.orderBy(F.xxhash64("frame")).coalesce(1).write.mode("append").parquet(path)
    return run.read_stream(df.sparkSession, path, df.schema, files=1)


#: The parts of a stream in SQL, with the newest frame that each clip had before a part.
PARTS_SQL = """, pt AS (SELECT *, least(frame//40 + CASE WHEN frame%5 = 2 THEN 1 ELSE 0 END, 3) AS part FROM fs),
         tops AS (SELECT clip_id, part, max(max(frame)) OVER (PARTITION BY clip_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
                  FROM pt GROUP BY clip_id, part)"""


@query(
    "stream_tumbling_counts",
    """WITH w AS (
          SELECT cast(user_id AS varchar) AS segment, epoch_us(ts) // 86400000000 AS day,
                 CASE WHEN event_type IN ('click','purchase') THEN 0 ELSE 1 END AS channel,
                 cast(least(greatest((event_id*53)%16-2, 0), 11) AS int) AS y,
                 cast(least(greatest((event_id*37)%20-2, 0), 15) AS int) AS x FROM events)
        SELECT segment, day, channel, y, x, count(*) AS n FROM w GROUP BY ALL""",
)
def stream_tumbling_counts(spark, sf):
    events = _event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("segment"), "ts",
        ((F.col("event_id") * 37) % 20 - 2).cast("double").alias("x"),
        ((F.col("event_id") * 53) % 16 - 2).cast("double").alias("y"),
        F.when(F.col("event_type").isin("click", "purchase"), 1.0).otherwise(-1.0).alias("p"),
    )
    events, end = run.ending(events, "tumbling")
    done = run.drain(live.tumbling_counts(events, "1 day", "1 hour", 12, 16), "tumbling", end)
    day = F.expr("unix_micros(window_start) div 86400000000L")
    return done.select("segment", day.alias("day"), "channel", "y", "x", "n")


@query(
    "stream_session_incidents",
    """WITH h AS (SELECT cast(user_id AS varchar) AS clip_id, epoch_us(ts) AS t, value/100 AS score FROM events WHERE value/100 >= 0.5),
        m AS (SELECT *, lag(t) OVER (PARTITION BY clip_id ORDER BY t) AS p FROM h),
        k AS (SELECT *, sum(CASE WHEN p IS NULL OR t > p + 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY t
                     ROWS UNBOUNDED PRECEDING) AS s FROM m)
        SELECT clip_id, min(t) AS first, max(t) AS last, round(max(score), 6) AS peak FROM k GROUP BY clip_id, s""",
)
def stream_session_incidents(spark, sf):
    scores = _event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("clip_id"), "ts", (F.col("value") / 100).alias("score")
    )
    scores, end = run.closing(scores, "sessions")
    done = run.drain(live.session_incidents(scores, 6 * 3600), "sessions", end)
    return done.select(
        "clip_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), r6("peak")
    )


@query(
    "stream_sliding_scores",
    with_tables(SCORE_STREAMS)
    + """, w AS (SELECT clip_id, start, score FROM (SELECT fs.*, unnest([frame//4*4, frame//4*4-4]) AS start FROM fs) WHERE start >= 0),
         g AS (SELECT clip_id, cast(start AS int) AS start, avg(score) AS score FROM w GROUP BY 1, 2 HAVING count(*) = 8)
         SELECT clip_id, start, round(score, 6) AS score FROM g""",
)
def stream_sliding_scores(spark, sf):
    stream, end = run.closing(_unordered_stream(score_streams(spark, sf), "scores", 40), "sliding")
    done = run.drain(live.sliding_scores(stream, 8, 4), "sliding", end)
    return done.select("clip_id", "start", r6("score"))


@query(
    "stream_motion",
    with_tables(VECTOR_JOINTS, MOTION) + "SELECT clip_id, frame, person, round(motion, 6) AS motion FROM pm",
)
def stream_motion(spark, sf):
    stream, end = run.closing(_unordered_stream(vector_poses(spark, sf), "poses", 3), "motion")
    return run.drain(stateful.motion(stream, disorder=4), "motion", end).select("clip_id", "frame", "person", r6("motion"))


@query(
    "stream_spikes",
    with_tables(SCORE_STREAMS)
    + f"""SELECT clip_id, frame, round(greatest(score - quantile_cont(score, 0.5) OVER (PARTITION BY clip_id
            ORDER BY frame ROWS BETWEEN {BASELINE} PRECEDING AND CURRENT ROW), 0), 6) AS spike FROM fs""",
)
def stream_spikes(spark, sf):
    stream, end = run.closing(_unordered_stream(score_streams(spark, sf), "scores", 40), "spikes")
    return run.drain(stateful.spikes(stream, BASELINE), "spikes", end).select("clip_id", "frame", r6("spike"))


@query(
    "stream_late_rows",
    with_tables(SCORE_STREAMS) + PARTS_SQL + " SELECT clip_id, frame FROM pt JOIN tops USING (clip_id, part) WHERE frame <= top - 8",
)
def stream_late_rows(spark, sf):
    """Rows that come too late for a scan that waits for eight frames only: its side table."""
    stream, end = run.closing(_unordered_stream(score_streams(spark, sf), "scores", 40), "late")
    late = run.drain_both(stateful.spikes(stream, BASELINE, disorder=8), "late", end)[1]
    return late.select("clip_id", "frame")


@query("stream_slot_tracking", with_tables(TRACKED) + "SELECT clip_id, frame, rank, person FROM slots")
def stream_slot_tracking(spark, sf):
    best = tracking.top_detections(tracking.with_default_confidence(detections(spark, sf)))
    stream, end = run.closing(_unordered_stream(tracking.detection_centroids(best), "centroids", 3), "slots")
    return run.drain(stateful.track_slots(stream, disorder=4), "slots", end).select("clip_id", "frame", "rank", "person")
