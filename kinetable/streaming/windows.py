"""Windowed stream operators. Each also works on a batch table (its twin)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.dims import SENSOR_HEIGHT, SENSOR_WIDTH
from kinetable.operators.events import to_sensor
from kinetable.streaming.ordered import scan
from kinetable.streaming.stateful import DISORDER


def tumbling_counts(
    events: DataFrame,
    duration: str = "33 milliseconds",
    watermark: str = "1 second",
    height: int = SENSOR_HEIGHT,
    width: int = SENSOR_WIDTH,
    key: str = "segment",
) -> DataFrame:
    """Event counts per (key, window, channel, y, x).

    Windows are aligned to the epoch. The batch operator aligns them to the first event
    of the segment, which an open stream cannot know; a segment whose first event falls
    on a window border gives equal frames.
    """
    binned = to_sensor(events.withWatermark("ts", watermark), height, width)
    return (
        binned.groupBy(key, F.window("ts", duration).alias("w"), "channel", "y", "x")
        .agg(F.count("*").alias("n"))
        .select(
            key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "channel", "y", "x", "n",
        )
    )


class Sliding:
    """Means of complete windows; carries the frames of the windows that are still open."""

    schema = "frame bigint, start int, score double"

    def __init__(self, window: int, stride: int, flush_right: bool):
        self.window, self.stride, self.flush_right = window, stride, flush_right

    def run(self, carry, orders, values, closing):
        held, size = len(carry) // 2, self.window
        frames = np.concatenate([carry[:held], orders]).astype(np.int64)
        scores = np.concatenate([carry[held:], values[:, 0]])
        ends = np.arange(held, len(frames))
        starts = frames[ends] - size + 1
        # All frames of a window have come if the one before it by its length is as many rows back.
        full = (ends >= size - 1) & (starts >= 0) & (starts % self.stride == 0)
        full[full] = frames[ends[full] - size + 1] == starts[full]
        at = ends[full]
        if closing and self.flush_right and len(frames):
            last, size_ = len(frames) - 1, min(size, int(frames[-1]) + 1)
            start = int(frames[-1]) + 1 - size_
            if last - size_ + 1 >= 0 and frames[last - size_ + 1] == start and (start % self.stride or size_ < size):
                at = np.append(at, last)
        sizes = np.minimum(size, frames[at] + 1)
        # One after the other in frame order, so that every run gives the same sum.
        means = [float(np.cumsum(scores[e - n + 1 : e + 1])[-1]) / n for e, n in zip(at.tolist(), sizes.tolist(), strict=True)]
        keep = frames > (frames[-1] - size if len(frames) else 0)
        rows = pd.DataFrame({"frame": frames[at], "start": (frames[at] - sizes + 1).astype(np.int32), "score": means})
        return [*frames[keep].astype(float), *scores[keep]], rows


def sliding_scores(
    scores: DataFrame,
    window: int = 64,
    stride: int = 16,
    key: str = "clip_id",
    disorder: int = DISORDER,
    idle: str | None = None,
    flush_right: bool = False,
) -> DataFrame:
    """Mean score of each complete sliding window of frames: (key, start, score), and ``late`` on a stream.

    Windows before frame 0 and incomplete ones are dropped. On a stream each clip has its own
    progress, so clips that start late keep their windows and frames may come in any order within
    ``disorder``; a stream that never ends sets ``idle``, the time without rows after which a clip is
    closed. ``flush_right`` adds the last window of a clip, which ends at its last frame, when the
    clip is closed (a shorter clip is one window). Sums run in frame order.
    """
    if scores.isStreaming:
        found = scan(scores, Sliding(window, stride, flush_right), [key], "frame", ["score"], disorder, idle)
        return found.select(key, "start", "score", "late", F.col("frame").cast("int").alias("frame"))
    first = f"cast(greatest(floor((frame - {window}) / {stride}) + 1, 0) as bigint)"
    slots = F.expr(f"explode(sequence({first}, cast(frame as bigint) div {stride}))")
    placed = scores.select(key, slots.alias("_slot"), F.struct("frame", "score").alias("_row")).select(
        key, (F.col("_slot") * stride).cast("int").alias("start"), "_row"
    )
    found = placed.groupBy(key, "start").agg(F.array_sort(F.collect_list("_row")).alias("_rows")).filter(F.size("_rows") == window)
    total = F.aggregate("_rows", F.lit(0.0), lambda a, row: a + row["score"])
    return found.select(key, "start", (total / window).alias("score"))


class Sessions:
    """Runs of hot rows; carries the open run as first, last and peak."""

    schema = "at bigint, first bigint, last bigint, peak double"

    def __init__(self, gap: int, threshold: float):
        self.gap, self.threshold = gap, threshold

    def run(self, carry, orders, values, closing):
        hot = values[:, 0] >= self.threshold
        times, peaks = orders[hot], values[hot, 0]
        if carry:
            # The open run is one row that lasts from its first to its last time.
            firsts, times = np.concatenate([[int(carry[0])], times]), np.concatenate([[int(carry[1])], times])
            peaks = np.concatenate([[carry[2]], peaks])
        else:
            firsts = times
        opens = np.flatnonzero(np.diff(times, prepend=times[:1] - self.gap - 1) > self.gap)
        ends = np.append(opens[1:], len(times)) - 1 if len(opens) else opens
        peak = np.maximum.reduceat(peaks, opens) if len(opens) else peaks
        rows = pd.DataFrame({"at": times[ends], "first": firsts[opens], "last": times[ends], "peak": peak})
        if closing or rows.empty:
            return [], rows
        return [float(x) for x in rows.iloc[-1][["first", "last", "peak"]]], rows.iloc[:-1]


def session_incidents(
    scores: DataFrame,
    gap_seconds: int,
    threshold: float = 0.5,
    disorder: str = "1 hour",
    key: str = "clip_id",
    idle: str | None = None,
) -> DataFrame:
    """Hot rows (NaN counts as no score) at most ``gap_seconds`` apart form one incident: (key, first, last, peak).

    On a stream each clip has its own progress along ``ts``: a clip that starts late keeps its
    incidents, and ``late`` marks rows further than ``disorder`` behind the newest of their clip.
    On the frame clock, windows of w frames with max_gap g use a gap of w + g seconds, and
    the incident ends at last + w.
    """
    if scores.isStreaming:
        micros = scores.withColumn("at", F.unix_micros("ts"))
        lag = int(pd.Timedelta(disorder).total_seconds() * 1_000_000)
        found = scan(micros, Sessions(gap_seconds * 1_000_000, threshold), [key], "at", ["score"], lag, idle)
        times = [F.timestamp_micros(c).alias(c) for c in ("first", "last")]
        return found.select(key, *times, "peak", "late", F.timestamp_micros("at").alias("ts"))
    hot = scores.filter((F.col("score") >= threshold) & ~F.isnan("score"))
    return (
        hot.groupBy(key, F.session_window("ts", f"{gap_seconds} seconds").alias("w"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("score").alias("peak"))
        .select(key, "first", "last", "peak")
    )
