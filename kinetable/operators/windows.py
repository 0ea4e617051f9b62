"""Sliding windows over clips: starts, membership, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.operators.chunks import attach_by_key, chunk_size


def last_start(frames: Column, window: int) -> Column:
    return F.greatest(frames - F.lit(window), F.lit(0))


def window_starts(
    clips: DataFrame, window: int = 64, stride: int = 16, key: str = "clip_id"
) -> DataFrame:
    """One row per window: 0, stride, ... and a flush-right window at the end of the clip.

    A clip no longer than the window has the single start 0. Starts are produced in
    blocks that are dealt out over the shuffle partitions.
    """
    slots = int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = chunk_size()
    counted = clips.select(
        key, F.col("num_frames"), last_start(F.col("num_frames"), window).alias("_last")
    ).withColumn("_steps", F.expr(f"cast(ceil(_last / {float(stride)}) as bigint)"))
    blocks = counted.withColumn(
        "_block", F.expr(f"explode(sequence(0L, _steps div {size}))")
    ).repartition(slots, key, "_block")
    steps = blocks.withColumn(
        "_step",
        F.expr(f"explode(sequence(_block * {size}, least(_block * {size} + {size} - 1, _steps)))"),
    )
    start = F.least(F.col("_step") * stride, F.col("_last")).cast("int")
    end = F.least(start + window, F.col("num_frames")).cast("int")
    return steps.select(key, start.alias("start"), end.alias("end"))


def covering_starts(frame: Column, frames: Column, window: int, stride: int) -> Column:
    """Array of the starts of all windows that contain ``frame`` in a clip of ``frames`` frames."""
    last = last_start(frames, window)
    first_step = F.greatest(F.ceil((frame - F.lit(window - 1)) / F.lit(float(stride))), F.lit(0))
    top_step = F.floor(F.least(frame, last) / F.lit(float(stride)))
    regular = F.when(
        first_step <= top_step,
        F.transform(
            F.sequence(first_step.cast("int"), top_step.cast("int")), lambda k: k * F.lit(stride)
        ),
    ).otherwise(F.array().cast("array<int>"))
    flush = F.when(
        (last % F.lit(stride) != 0) & (frame >= last), F.array(last.cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(regular, flush)


def assign_windows(
    df: DataFrame,
    clips: DataFrame,
    window: int = 64,
    stride: int = 16,
    key: str = "clip_id",
    frame: str = "frame",
) -> DataFrame:
    """Repeat each frame row once per window that contains it; adds start and window_frames.

    The starts follow from arithmetic on the frame number, so there is no range join.
    """
    lengths = clips.select(key, F.col("num_frames").alias("_frames"), F.col("num_frames").alias("_w"))
    sized = attach_by_key(df, lengths, key, "_w", [frame])
    starts = covering_starts(F.col(frame), F.col("_frames"), window, stride)
    return sized.withColumn("start", F.explode(starts)).withColumn(
        "window_frames", F.least(F.col("_frames"), F.lit(window))
    ).drop("_frames")


def pad_or_truncate(
    poses: DataFrame, clips: DataFrame, target: int = 64, key: str = "clip_id"
) -> DataFrame:
    """Fixed-length clips: cut at ``target`` frames or repeat the last frame; adds ``t``."""
    lengths = clips.select(key, F.col("num_frames").alias("_frames"), F.col("num_frames").alias("_w"))
    sized = attach_by_key(poses, lengths, key, "_w", ["frame"]).filter(F.col("frame") < target)
    slots = F.when(
        (F.col("frame") == F.col("_frames") - 1) & (F.col("_frames") < target),
        F.sequence(F.col("frame"), F.lit(target - 1)),
    ).otherwise(F.array("frame"))
    return sized.withColumn("t", F.explode(slots)).drop("_frames")


def frame_windows(
    scores: DataFrame, clips: DataFrame, window: int, key: str = "clip_id"
) -> DataFrame:
    """Window rows repeated for each frame they cover, clipped at the end of the clip."""
    lengths = clips.select(key, F.col("num_frames").alias("_frames"), F.col("num_frames").alias("_w"))
    sized = attach_by_key(scores, lengths, key, "_w", ["start"])
    return sized.withColumn(
        "frame",
        F.explode(F.sequence(F.col("start"), F.least(F.col("start") + window, F.col("_frames")) - 1)),
    ).drop("_frames")
