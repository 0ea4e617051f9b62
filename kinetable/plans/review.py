"""The review job: model scores and activity signals per frame, incidents, trigger, marks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.config import ReviewConfig
from kinetable.operators.incidents import (
    add_marks,
    earliest_before,
    find_incidents,
    flag_kind,
    keep_top_incidents,
    parse_marks,
)
from kinetable.operators.people import crowd_pressure
from kinetable.operators.scoring import Scorer
from kinetable.operators.signals import (
    activity_curve,
    activity_pairs,
    arbitrate,
    convergence_peak,
    frame_scores,
    highlight,
    motion_energy,
    moving_average,
    person_frames,
    pressure_spikes,
)
from kinetable.plans.localize import score_pairs, score_windows
from kinetable.session import materialize


@dataclass
class Review:
    """frames: one row per frame; incidents: spans for review; trigger: at most one span per stream."""

    frames: DataFrame
    incidents: DataFrame
    trigger: DataFrame | None


def activity_frames(
    people: DataFrame, clips: DataFrame, cfg: ReviewConfig, key: str = "clip_id"
) -> DataFrame:
    """Per-frame activity curve, pressure spike and the pair around the most agitated person.

    ``people`` is the result of ``person_frames``.
    """
    stats, motion = people.filter(F.col("n") > 0), people.select(key, "frame", "person", "motion")
    energy = motion_energy(motion, clips, key)
    pressure = crowd_pressure(stats, clips, key, cfg.max_persons)
    signals = energy.join(pressure, [key, "frame"])
    smooth = moving_average(signals, "energy", cfg.smooth_frames, "smooth", key)
    spiked = pressure_spikes(smooth, "pressure", cfg.baseline_frames, "spike", key)
    curve = activity_curve(
        F.col("smooth"), F.col("spike"), cfg.motion_floor, cfg.motion_saturate,
        cfg.motion_weight, cfg.pressure_weight,
    )
    pairs = activity_pairs(stats, motion, clips, cfg.smooth_frames, key, cfg.max_persons)
    return spiked.select(key, "frame", "spike", curve.alias("activity")).join(
        pairs.withColumnRenamed("pair", "activity_pair"), [key, "frame"]
    )


def review_frames(
    poses: DataFrame,
    clips: DataFrame,
    scorer: Scorer,
    cfg: ReviewConfig = ReviewConfig(),
    crowd: bool = True,
    level: str = "joint",
    key: str = "clip_id",
) -> DataFrame:
    """Per frame: model, activity, score, is_activity, pair (and spike in crowd scenes).

    Skeletons are reduced once to a narrow table of person statistics, which is stored
    because the pair search and every activity signal read it.
    """
    if not crowd:
        windows = score_windows(poses, clips, scorer, cfg, level, key)
        curve = frame_scores(windows, clips, cfg.window, key)
        return curve.select(
            key, "frame", F.col("score").alias("model"), F.lit(None).cast("double").alias("activity"),
            "score", F.lit(False).alias("is_activity"), "pair", F.lit(0.0).alias("spike"),
        )
    people = materialize(person_frames(poses, key=key), "people")
    windows = score_pairs(
        poses, clips, scorer, cfg, level, key, stats=people.filter(F.col("n") > 0)
    )
    model = frame_scores(windows, clips, cfg.window, key).withColumnsRenamed(
        {"score": "model", "pair": "model_pair"}
    )
    joined = arbitrate(model.join(activity_frames(people, clips, cfg, key), [key, "frame"]))
    pair = highlight(F.col("is_activity"), F.col("activity_pair"), F.col("model_pair"))
    return joined.select(
        key, "frame", "model", "activity", "score", "is_activity", pair.alias("pair"), "spike"
    )


def review(
    poses: DataFrame,
    clips: DataFrame,
    scorer: Scorer,
    cfg: ReviewConfig = ReviewConfig(),
    crowd: bool = True,
    marks: DataFrame | None = None,
    level: str = "joint",
    key: str = "clip_id",
) -> Review:
    """Everything a reviewer needs. Clips with more than two person slots are crowd scenes.

    Frame rows feed three consumers, so they are written to the shared scratch folder once.
    """
    frames = materialize(review_frames(poses, clips, scorer, cfg, crowd, level, key), "review-frames")
    found = find_incidents(frames, 1, cfg.threshold, cfg.max_gap, key, start="frame")
    scored = frames
    if cfg.top_incidents:
        scored, found = keep_top_incidents(frames, found, cfg.threshold, cfg.top_incidents, key)
    trigger = None
    if crowd:
        peaks = convergence_peak(frames, "spike", key)
        trigger = earliest_before(found, peaks, clips, int(cfg.fps), key)
    if marks is None:
        scored = scored.withColumn("is_manual", F.lit(False))
    else:
        spans = parse_marks(marks, clips, cfg.fps, key)
        scored, found = add_marks(scored, found, spans, cfg.threshold, key)
    kind = flag_kind(F.col("score"), cfg.threshold, F.col("is_manual"), F.col("is_activity"))
    return Review(scored.withColumn("kind", kind), found, trigger)
