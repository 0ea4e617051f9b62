"""Windows -> scores -> incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.config import LocalizeConfig
from kinetable.operators.features import pair_features, window_features
from kinetable.operators.incidents import find_incidents
from kinetable.operators.people import candidate_pairs, person_stats
from kinetable.operators.scoring import Scorer, worst_pairs
from kinetable.operators.windows import window_starts


def score_windows(
    poses: DataFrame,
    clips: DataFrame,
    scorer: Scorer,
    cfg: LocalizeConfig = LocalizeConfig(),
    level: str = "joint",
    key: str = "clip_id",
    persons: int = 2,
) -> DataFrame:
    """One score per window over all people: (key, start, prob)."""
    features = window_features(
        poses, clips, cfg.window, cfg.stride, persons, cfg.normalize, level, key
    )
    return scorer(features).select(key, "start", "prob")


def score_pairs(
    poses: DataFrame,
    clips: DataFrame,
    scorer: Scorer,
    cfg: LocalizeConfig = LocalizeConfig(),
    level: str = "joint",
    key: str = "clip_id",
    stats: DataFrame | None = None,
) -> DataFrame:
    """Crowd scoring: per window the worst interacting pair, (key, start, prob, pair).

    Pairs below the height gate are never scored; a window without pairs scores 0.
    ``stats`` may hand in person statistics that are already stored.
    """
    pairs = candidate_pairs(
        person_stats(poses, key) if stats is None else stats, clips, cfg.window, cfg.stride, cfg.max_pairs, cfg.distance_scale,
        cfg.min_visibility, cfg.min_pair_height, key, cfg.max_persons,
    )
    features = pair_features(
        poses, clips, pairs, cfg.window, cfg.stride, cfg.normalize, level, key
    )
    scored = scorer(features).join(pairs.select(key, "start", "i", "j", "rank"), [key, "start", "i", "j"])
    return worst_pairs(window_starts(clips, cfg.window, cfg.stride, key), scored, key)


def localize(
    poses: DataFrame,
    clips: DataFrame,
    scorer: Scorer,
    cfg: LocalizeConfig = LocalizeConfig(),
    crowd_aware: bool = True,
    level: str = "joint",
    key: str = "clip_id",
) -> DataFrame:
    """Incidents of every stream: (key, start, end, peak)."""
    score = score_pairs if crowd_aware else score_windows
    scores = score(poses, clips, scorer, cfg, level, key)
    return find_incidents(
        scores.select(key, "start", F.col("prob").alias("score")),
        cfg.window, cfg.threshold, cfg.max_gap, key,
    )
