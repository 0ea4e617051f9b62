"""Per-frame signals: motion energy, smoothing, spikes, score curves, highlights.

Bounded windows run inside (stream, chunk) with a halo (see ``chunks``), never over a
whole stream in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kinetable.functions.joints import distance, shared_steps
from kinetable.functions.numeric import clip
from kinetable.operators.batches import equal_runs
from kinetable.operators.chunks import attach_by_key, explode_span, frame_spine, with_chunk, with_halo
from kinetable.operators.people import ROW_SLOTS, checked_slot, with_stats

MIN_MOTION_HEIGHT = 8.0  # pixels (fixed value)
TASK_FRAMES = 1 << 20  # frames whose scores one task sums, about
PRESSURE_CEILING = 0.99  # activity from pressure spikes stays below 1 (fixed value)


# --- score curves ---------------------------------------------------------------------


def frame_scores(
    scores: DataFrame, clips: DataFrame, window: int = 64, key: str = "clip_id"
) -> DataFrame:
    """Per frame the mean of the covering windows (0 if none) and the best window's pair.

    ``scores`` has key, start, prob and optionally pair. The earliest of equally strong
    windows gives the pair.
    """
    if "pair" not in scores.columns:
        scores = scores.withColumn("pair", F.lit(None).cast("struct<i:int,j:int>"))
    lengths = clips.select(key, F.col("num_frames").alias("_frames"), F.col("num_frames").alias("_w"))
    sized = attach_by_key(scores.select(key, "start", "prob", "pair"), lengths, key, "_w", ["start"])
    covered = sized.withColumn("_end", F.least(F.col("start") + window, F.col("_frames"))).drop("_frames")
    whole = clips.select(key, F.lit(0).alias("start"), F.col("num_frames").alias("_end"))
    spans = covered.unionByName(whole, allowMissingColumns=True).withColumn("_first", F.col("start"))
    total = clips.agg(F.sum(F.col("num_frames").cast("long"))).first()[0] or 0
    rows = explode_span(spans, "_first", "_end", key, parts=total // TASK_FRAMES + 1, piece="_piece")
    order = F.when(F.col("prob").isNotNull(), F.struct("prob", -F.col("start")))
    # Rows of a piece are together already; grouping by it as well needs no second shuffle.
    return rows.groupBy(key, "_piece", "frame").agg(
        F.coalesce(F.avg("prob"), F.lit(0.0)).alias("score"),
        F.max_by("pair", order).alias("pair"),
    ).drop("_piece")


# --- smoothing and scaling -----------------------------------------------------------


def moving_average(
    df: DataFrame,
    value: str,
    width: int,
    out: str = "smooth",
    key: str = "clip_id",
    frame: str = "frame",
    per: list[str] | None = None,
) -> DataFrame:
    """Centred box filter, zero padded: the divisor is always ``width``."""
    width = max(1, int(width))
    back, ahead = width // 2, (width - 1) // 2
    halo = with_halo(df, frame, back, ahead)
    box = (
        Window.partitionBy(key, "chunk", *(per or []))
        .orderBy(F.col(frame).cast("bigint"))
        .rangeBetween(-back, ahead)
    )
    return (
        halo.withColumn(out, F.sum(value).over(box) / F.lit(float(width)))
        .filter("core")
        .drop("chunk", "core")
    )


def pressure_spikes(
    df: DataFrame,
    value: str,
    baseline: int,
    out: str = "spike",
    key: str = "clip_id",
    frame: str = "frame",
) -> DataFrame:
    """Rise above the median of the current and the ``baseline`` previous frames, at least 0.

    Frames are dense (see ``frame_spine``). Spark deals the chunks out and sorts them; the
    trailing median is a rolling one, which slides in logarithmic time, whereas a Spark
    window would rebuild the ordered frame for every row.
    """
    back = int(baseline)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, past = None, np.empty(0)
        for part in batches:
            values = part[value].to_numpy(dtype=float)
            names, pieces = part[key].to_numpy(), part["chunk"].to_numpy()
            rises = np.empty(len(part))
            for low, high in equal_runs(pieces, names):
                if (names[low], pieces[low]) != owner:
                    owner, past = (names[low], pieces[low]), np.empty(0)
                series = np.concatenate([past, values[low:high]])
                median = pd.Series(series).rolling(back + 1, min_periods=1).median().to_numpy()
                rises[low:high] = np.maximum(values[low:high] - median[len(past):], 0.0)
                past = series[max(0, len(series) - back):]
            part[out] = rises
            yield part[part["core"]].drop(columns=["chunk", "core"])

    halo = with_halo(df, frame, back=back)
    ordered = halo.repartition(key, "chunk").sortWithinPartitions(key, "chunk", frame)
    return ordered.mapInPandas(scan, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def normalize_signal(
    df: DataFrame, value: str, out: str = "scaled", key: str = "clip_id", frame: str = "frame"
) -> DataFrame:
    """Min-max scaling per stream; constant streams become 0.

    The range is summed up per chunk first; each chunk then reads its stream's range, so
    the join key never gathers more than one chunk.
    """
    chunked = with_chunk(df, frame)
    parts = chunked.groupBy(key, "chunk").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    whole = Window.partitionBy(key)
    ranges = parts.select(
        key, "chunk", F.min("_lo").over(whole).alias("_low"), F.max("_hi").over(whole).alias("_high")
    )
    span = F.col("_high") - F.col("_low")
    return (
        chunked.join(ranges, [key, "chunk"])
        .withColumn(
            out, F.when(span > 0, (F.col(value) - F.col("_low")) / span).otherwise(F.lit(0.0))
        )
        .drop("chunk", "_low", "_high")
    )


# --- motion ----------------------------------------------------------------------------


def person_frames(poses: DataFrame, min_joints: int = 3, key: str = "clip_id") -> DataFrame:
    """Every skeleton reduced to its statistics and its motion, in one pass over the joints.

    ``motion`` is the mean displacement of the joints visible now and one frame before,
    divided by the height of the visible joints; the other columns are those of
    ``person_stats``. This is the only step that moves whole skeletons.
    """
    halo = with_halo(poses.select(key, "frame", "person", "joints"), back=1)
    track = Window.partitionBy(key, "chunk", "person").orderBy("frame")
    linked = halo.withColumns(
        {"_before": F.lag("joints").over(track), "_at": F.lag("frame").over(track)}
    ).filter("core")
    moves = shared_steps(F.col("joints"), F.col("_before"))
    stepped = with_stats(
        linked.withColumn("_moves", F.when(F.col("_at") == F.col("frame") - 1, moves)),
        [key, "frame", "person", "_moves"],
    )
    mean = F.aggregate("_moves", F.lit(0.0), lambda acc, d: acc + d) / F.size("_moves")
    height = F.greatest(F.col("high") - F.col("low"), F.lit(MIN_MOTION_HEIGHT))
    return stepped.withColumn(
        "motion", F.when(F.size("_moves") >= min_joints, mean / height).otherwise(F.lit(0.0))
    ).drop("_moves")


def person_motion(poses: DataFrame, min_joints: int = 3, key: str = "clip_id") -> DataFrame:
    """Height-normalized mean joint displacement of each person since the previous frame."""
    return person_frames(poses, min_joints, key).select(key, "frame", "person", "motion")


def motion_energy(motion: DataFrame, clips: DataFrame, key: str = "clip_id") -> DataFrame:
    """Most agitated person per frame; frames without people are 0."""
    rows = motion.select(key, "frame", "motion").unionByName(
        frame_spine(clips, key).withColumn("motion", F.lit(0.0))
    )
    return rows.groupBy(key, "frame").agg(F.max("motion").alias("energy"))


def activity_pairs(
    stats: DataFrame,
    motion: DataFrame,
    clips: DataFrame,
    smooth: int,
    key: str = "clip_id",
    max_persons: int = 16,
) -> DataFrame:
    """Per frame the person with the highest smoothed motion and the nearest visible other.

    Every frame is returned; pair is NULL when nobody moves, the mover is not visible, or
    nobody else is. The highest slot wins equal motion, the lowest slot equal distance.
    ``stats`` is the result of ``person_stats``, ``motion`` of ``person_motion``.
    """
    if max_persons > ROW_SLOTS:
        return _activity_pairs_by_rows(stats, motion, clips, smooth, key, max_persons)
    rows = _smoothed_people(stats, motion, clips, smooth, key, max_persons)
    people = rows.groupBy(key, "frame").agg(
        F.collect_list(F.struct("smooth", "person", "cx", "cy")).alias("people")
    )
    lead = people.withColumn("a", F.array_max("people"))
    others = F.filter("people", lambda p: p.cx.isNotNull() & (p.person != F.col("a.person")))
    near = F.array_min(
        F.transform(
            others,
            lambda b: F.struct(
                distance(F.col("a.cx"), F.col("a.cy"), b.cx, b.cy).alias("d"), b.person.alias("person")
            ),
        )
    )
    found = lead.withColumn(
        "near", F.when((F.col("a.smooth") > 0) & F.col("a.cx").isNotNull(), near)
    )
    return found.select(key, "frame", _pair(F.col("a.person"), F.col("near.person")))


def _activity_pairs_by_rows(stats, motion, clips, smooth, key, max_persons) -> DataFrame:
    """Same result for slot counts too large for one row: one aggregate per step."""
    rows = _smoothed_people(stats, motion, clips, smooth, key, max_persons)
    lead = (
        rows.groupBy(key, "frame")
        .agg(F.max(F.struct("smooth", "person", "cx", "cy")).alias("a"))
    )
    reach = rows.filter(F.col("cx").isNotNull()).join(
        lead.filter((F.col("a.smooth") > 0) & F.col("a.cx").isNotNull()), [key, "frame"]
    ).filter(F.col("person") != F.col("a.person"))
    near = reach.groupBy(key, "frame").agg(
        F.min(
            F.struct(
                distance(F.col("a.cx"), F.col("a.cy"), F.col("cx"), F.col("cy")).alias("d"), "person"
            )
        ).alias("near")
    )
    return lead.join(near, [key, "frame"], "left").select(
        key, "frame", _pair(F.col("a.person"), F.col("near.person"))
    )


def _pair(a: Column, b: Column) -> Column:
    return F.when(
        b.isNotNull(), F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    ).alias("pair")


def _smoothed_people(stats, motion, clips, smooth, key, max_persons) -> DataFrame:
    """Every slot of every frame with its smoothed motion, and its centroid where visible."""
    spine = frame_spine(clips, key).withColumn(
        "person", F.explode(F.sequence(F.lit(0), F.lit(max_persons - 1)))
    )
    centres = stats.select(
        key, "frame", checked_slot(max_persons).alias("person"), "cx", "cy"
    )
    rows = (
        motion.select(key, "frame", "person", "motion")
        .unionByName(centres, allowMissingColumns=True)
        .unionByName(spine, allowMissingColumns=True)
        .groupBy(key, "frame", "person")
        .agg(
            F.coalesce(F.max("motion"), F.lit(0.0)).alias("motion"),
            F.max("cx").alias("cx"),
            F.max("cy").alias("cy"),
        )
    )
    return moving_average(rows, "motion", smooth, "smooth", key, per=["person"])


# --- blending ---------------------------------------------------------------------------


def activity_curve(
    smooth_motion: Column,
    spike: Column,
    motion_floor: float = 0.5,
    motion_saturate: float = 2.0,
    motion_weight: float = 0.9,
    pressure_weight: float = 1.5,
) -> Column:
    """Motion ramped between floor and saturation, or the weighted pressure spike if higher."""
    span = max(motion_saturate - motion_floor, 1e-6)
    ramp = clip((smooth_motion - motion_floor) / span, 0.0, 1.0) * motion_weight
    return F.greatest(ramp, clip(spike * pressure_weight, 0.0, PRESSURE_CEILING))


def arbitrate(df: DataFrame, model: str = "model", activity: str = "activity") -> DataFrame:
    """Final score is the larger source; is_activity marks frames the heuristic won outright."""
    return df.withColumns(
        {
            "is_activity": F.col(activity) > F.col(model),
            "score": F.greatest(F.col(model), F.col(activity)),
        }
    )


def highlight(is_activity: Column, activity_pair: Column, model_pair: Column) -> Column:
    return F.coalesce(F.when(is_activity, activity_pair), model_pair)


def convergence_peak(
    spikes: DataFrame, value: str = "spike", key: str = "clip_id", frame: str = "frame"
) -> DataFrame:
    """First frame with the highest spike per stream; streams whose spikes are all 0 have none."""
    best = spikes.groupBy(key).agg(
        F.max_by(frame, F.struct(F.col(value), -F.col(frame))).alias("peak_frame"),
        F.max(value).alias("peak_spike"),
        F.count("*").alias("frames"),
    )
    return best.filter(F.col("peak_spike") > 0)
