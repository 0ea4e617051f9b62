import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import incidents, signals, tracking, windows
from kinetable.streaming import run, stateful
from kinetable.streaming import windows as live
from tests.helpers import clips_frame, poses_frame, random_scene
from tests.test_operators import detection_frame, series_frame


def as_stream(spark, df, folder, order, parts):
    """The rows split over ``parts`` files in the order of ``order``, one file per micro-batch."""
    ranked = df.toPandas().sort_values(order, kind="stable")
    values = ranked[order].to_numpy()
    for i, chunk in enumerate(np.array_split(np.unique(values), parts)):
        path = f"{folder}/{i}"
        spark.createDataFrame(ranked[ranked[order].isin(chunk)], df.schema).coalesce(1).write.parquet(path)
        name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.utime(f"{path}/{name}", (1_700_000_000 + i * 10,) * 2)
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    )


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    return {"a": rng.random(90).round(2).tolist(), "b": rng.random(50).round(2).tolist()}


def delayed(spark, df, folder, frames=20):
    """A stream of micro-batches with every fifth frame one batch late; clip ``b`` starts when ``a`` is over."""
    late = F.when(F.col("frame") % 5 == 2, 1).otherwise(0) + F.when(F.col("clip_id") == "b", 5).otherwise(0)
    parts = df.withColumn("part", F.expr(f"frame div {frames}") + late)
    return as_stream(spark, parts, folder, "part", parts.agg(F.max("part")).first()[0] + 1).drop("part")


def drained(stream, label, operator):
    stream, end = run.closing(stream, label)
    return run.drain(operator(stream), label, end)


def test_spikes_match_batch(spark, tmp_path, series):
    df = series_frame(spark, series)
    got = drained(delayed(spark, df, tmp_path), "t-spikes", lambda s: stateful.spikes(s, 7, disorder=25))
    want = signals.pressure_spikes(df, "score", 7).select("clip_id", "frame", "spike")
    assert rows(got) == rows(want)


def test_motion_matches_batch(spark, tmp_path):
    poses = poses_frame(spark, {"a": random_scene(1, 40, 3), "b": random_scene(2, 25, 2)})
    got = drained(delayed(spark, poses, tmp_path, 10), "t-motion", lambda s: stateful.motion(s, disorder=12))
    want = signals.person_motion(poses).select("clip_id", "person", "frame", "motion")
    assert rows(got) == rows(want)


def test_tracking_matches_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    found = detection_frame(
        spark,
        [(f"c{c}", f, d, float(rng.random()), float(rng.uniform(0, 80) + 50 * d), float(rng.uniform(0, 80)), 1.0)
         for c in range(3) for f in range(30) for d in range(rng.integers(1, 4))],
    )
    best = tracking.top_detections(tracking.with_default_confidence(found), 3)
    centres = tracking.detection_centroids(best)
    # A frame's detections are spread over micro-batches too.
    parts = centres.withColumn("part", (F.col("frame") + 7 * F.col("rank")) / 8)
    stream = as_stream(spark, parts, tmp_path, "part", 5).drop("part")
    got = drained(stream, "t-slots", lambda s: stateful.track_slots(s, 3, disorder=20))
    want = tracking.assign_slots(centres, 3).select("clip_id", "frame", "rank", "person")
    assert rows(got) == rows(want)


def test_sessions_match_incidents(spark, tmp_path, series):
    """On the frame clock a clip that starts when another is over keeps its incidents."""
    window, gap = 1, 2
    df = run.frame_clock(series_frame(spark, series | {"nan": [float("nan")] * 3 + [1.0]}))
    got = drained(delayed(spark, df, tmp_path), "t-sessions", lambda s: live.session_incidents(s, window + gap, disorder="25 seconds")).drop("ts")
    assert rows(got) == rows(live.session_incidents(df, window + gap))
    frames = got.select(
        "clip_id", F.unix_seconds("first").cast("int").alias("start"), (F.unix_seconds("last") + window).cast("int").alias("end"), "peak"
    )
    want = incidents.find_incidents(df, window, 0.5, gap, start="frame")
    assert rows(frames) == rows(want.select("clip_id", "start", "end", "peak"))
    assert {r["clip_id"] for r in frames.collect()} == {"a", "b", "nan"}


def test_sliding_matches_complete_windows(spark, tmp_path, series):
    df = series_frame(spark, series | {"short": [0.5] * 5, "gap": [0.25] * 30}).filter("clip_id <> 'gap' or frame <> 13")
    got = drained(delayed(spark, df, tmp_path), "t-sliding", lambda s: live.sliding_scores(s, 8, 4, disorder=25)).drop("frame")
    assert rows(got) == rows(live.sliding_scores(df, 8, 4))
    assert {r["start"] for r in got.filter("clip_id = 'gap'").collect()} == {0, 4, 16, 20}


def test_closed_clips_have_their_last_window(spark, tmp_path, series):
    series = series | {"short": [0.5] * 5}
    df, lengths = series_frame(spark, series), clips_frame(spark, {k: len(v) for k, v in series.items()})
    got = drained(delayed(spark, df, tmp_path), "t-flush", lambda s: live.sliding_scores(s, 8, 4, disorder=25, flush_right=True))
    want = windows.assign_windows(df, lengths, 8, 4).groupBy("clip_id", "start").agg(F.avg("score").alias("score"))
    assert rows(got.drop("frame")) == rows(want)


def test_late_rows_have_a_table_and_state_ends_empty(spark, tmp_path, series):
    df = series_frame(spark, series)
    stream, end = run.closing(delayed(spark, df, tmp_path), "t-late")
    scanned = stateful.spikes(stream, 7, disorder=4)
    query, path = run.start(scanned, "t-late")
    query.awaitTermination()
    open_keys = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    for _ in range(2):
        end()
        last, _ = run.start(scanned, "t-late", path)
        last.awaitTermination()
    assert open_keys > 0 and last.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    results, late = (spark.read.parquet(path).filter(f"_late = {x}") for x in ("false", "true"))
    seen = {(r["clip_id"], r["frame"]) for r in late.collect()}
    assert seen and all(f % 5 == 2 for _, f in seen)
    assert results.count() + len(seen) == df.count()


def test_ended_streams_emit_everything(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [("s", t0 + timedelta(milliseconds=10 * i), float(i % 5), 2.0, float(i % 3 - 1)) for i in range(100)],
        "segment string, ts timestamp, x double, y double, p double",
    )
    stream, end = run.ending(as_stream(spark, events, tmp_path / "e", "ts", 3), "t-end-events")
    got = run.drain(live.tumbling_counts(stream, "100 milliseconds", "1 second", 10, 10), "t-ended-events", end)
    assert rows(got) == rows(live.tumbling_counts(events, "100 milliseconds", "1 second", 10, 10))


def test_tumbling_counts_and_late_rows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    early = [("s", t0 + timedelta(milliseconds=10 * i), float(i % 5), 2.0, float(i % 3 - 1)) for i in range(300)]
    late = [("s", t0 + timedelta(milliseconds=5), 1.0, 2.0, 1.0)] * 3
    schema = "segment string, ts timestamp, x double, y double, p double"
    early_rows = spark.createDataFrame(early, schema)
    folder = tmp_path / "in"
    for i, part in enumerate((early_rows.filter("ts < '2024-01-01 00:00:02'"), early_rows.filter("ts >= '2024-01-01 00:00:02'"),
                              spark.createDataFrame(late, schema))):
        part.coalesce(1).write.parquet(f"{folder}/{i}")
        name = next(f for f in os.listdir(f"{folder}/{i}") if f.endswith(".parquet"))
        os.utime(f"{folder}/{i}/{name}", (1_700_000_000 + i * 10,) * 2)
    stream = spark.readStream.schema(early_rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    counted = live.tumbling_counts(stream, "100 milliseconds", "100 milliseconds", 10, 10)
    with run.LateRows(spark) as late:
        query, path = run.start(counted, "t-tumbling")
        assert late.of(query) >= 1  # the late rows share one group, which is dropped
    got = spark.read.parquet(path)
    want = live.tumbling_counts(early_rows, "100 milliseconds", "100 milliseconds", 10, 10)
    closed = want.filter("window_end <= '2024-01-01 00:00:02.89'")
    assert rows(got) == rows(closed) and closed.count() > 20
