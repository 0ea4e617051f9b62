"""Incident intervals: merging, ranking, manual marks, matching against ground truth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.numeric import seconds, temporal_iou
from kinetable.operators.chunks import attach_by_key, earlier, explode_span, with_halo

DEMOTED = 0.9  # demoted frames stay at or below this share of the threshold (fixed value)
MARK_LIFT = 0.01  # manual marks are lifted this much above the threshold (fixed value)


def find_incidents(
    scores: DataFrame,
    window: int,
    threshold: float = 0.5,
    max_gap: int = 0,
    key: str = "clip_id",
    start: str = "start",
    score: str = "score",
) -> DataFrame:
    """Merge hot windows into incidents (key, start, end, peak).

    Windows have one length, so a window opens a new incident exactly when the previous
    hot one started more than ``window + max_gap`` frames earlier. That needs a bounded
    look back: breaks are found inside (key, chunk). Runs are first reduced per chunk;
    only a run that continues from an earlier chunk looks up where it began.
    NaN scores count as absent.
    """
    hot = scores.filter((F.col(score) >= threshold) & ~F.isnan(score)).select(
        key, F.col(start).alias("_s"), F.col(score).cast("double").alias("_v")
    )
    reach = int(window) + int(max_gap)
    halo = with_halo(hot, "_s", back=reach)
    order = Window.partitionBy(key, "chunk").orderBy("_s")
    before = F.lag("_s").over(order)
    opened = halo.withColumn(
        "_open", F.when(before.isNull() | (F.col("_s") > before + reach), F.col("_s"))
    ).filter("core")
    runs = opened.withColumn(
        "_run", F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    pieces = runs.groupBy(key, "chunk", "_run").agg(
        F.min("_s").alias("_s"), (F.max("_s") + window).alias("_e"), F.max("_v").alias("_v")
    )
    # The run a chunk hands on; NULL where the whole chunk continues an earlier run. It keeps
    # every column of the pieces, so that both branches read one and the same shuffle.
    handed = pieces.groupBy(key, "chunk").agg(F.max(F.struct("_run", "_s", "_e", "_v")).alias("_last"))
    carried = handed.select(key, "chunk", F.max("_last").over(earlier(key))["_run"].alias("_carry"))
    placed = pieces.join(carried, [key, "chunk"]).withColumn("_run", F.coalesce("_run", "_carry"))
    return placed.groupBy(key, "_run").agg(
        F.min("_s").cast("int").alias("start"),
        F.max("_e").cast("int").alias("end"),
        F.max("_v").alias("peak"),
    ).drop("_run")


def rank_incidents(incidents: DataFrame, top_n: int, key: str = "clip_id") -> DataFrame:
    """Strongest ``top_n`` incidents per stream; earlier ones win equal peaks."""
    order = Window.partitionBy(key).orderBy(F.col("peak").desc(), "start")
    return incidents.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def keep_top_incidents(
    scores: DataFrame,
    incidents: DataFrame,
    threshold: float,
    top_n: int,
    key: str = "clip_id",
    score: str = "score",
) -> tuple[DataFrame, DataFrame]:
    """(adjusted frame scores, kept incidents): frames of the others drop below the threshold."""
    kept = rank_incidents(incidents, top_n, key).drop("rank")
    dropped = incidents.join(kept.select(key, "start"), [key, "start"], "left_anti")
    demoted = (
        explode_span(dropped.select(key, "start", "end"), "start", "end", key)
        .select(key, "frame")
        .distinct()
        .withColumn("_demoted", F.lit(True))
    )
    adjusted = (
        scores.join(demoted, [key, "frame"], "left")
        .withColumn(
            score,
            F.when(F.col("_demoted"), F.least(F.col(score), F.lit(threshold * DEMOTED))).otherwise(
                F.col(score)
            ),
        )
        .drop("_demoted")
    )
    return adjusted, kept


def earliest_before(
    incidents: DataFrame,
    peaks: DataFrame,
    clips: DataFrame,
    pad: int,
    key: str = "clip_id",
) -> DataFrame:
    """Per stream the first incident that starts before ``peak_frame``, padded and clamped.

    ``peaks`` has key, peak_frame, frames (its weight).
    """
    timed = attach_by_key(
        incidents, peaks.select(key, "peak_frame", "frames"), key, "frames", ["start"]
    )
    first = (
        timed.filter(F.col("start") < F.col("peak_frame"))
        .groupBy(key)
        .agg(
            F.min(F.struct("start", "end", "peak")).alias("i"),
            F.first("peak_frame").alias("peak_frame"),
        )
    )
    return first.join(clips.select(key, "num_frames"), key).select(
        key,
        "peak_frame",
        F.greatest(F.col("i.start") - pad, F.lit(0)).alias("start"),
        F.least(F.col("i.end") + pad, F.col("num_frames")).alias("end"),
        F.col("i.peak").alias("peak"),
    )


def parse_marks(marks: DataFrame, clips: DataFrame, fps: float, key: str = "clip_id") -> DataFrame:
    """Second spans such as ``65-80`` -> frame spans; empty spans are dropped."""
    low = F.substring_index("mark", "-", 1).cast("double")
    high = F.regexp_replace("mark", r"^[^-]*-", "").cast("double")
    spans = marks.join(clips.select(key, "num_frames"), key).select(
        key,
        F.greatest((low * fps).cast("int"), F.lit(0)).alias("start"),
        F.least((high * fps).cast("int"), F.col("num_frames")).alias("end"),
        F.lit(0.0).alias("peak"),
    )
    return spans.filter(F.col("end") > F.col("start"))


def mark_peak(score: Column, threshold: float) -> Column:
    return F.round(F.greatest(score, F.lit(threshold + MARK_LIFT)), 6)


def add_marks(
    scores: DataFrame,
    incidents: DataFrame,
    marks: DataFrame,
    threshold: float,
    key: str = "clip_id",
    score: str = "score",
) -> tuple[DataFrame, DataFrame]:
    """(lifted frame scores with is_manual, incidents and marks together)."""
    lifted = marks.select(key, "start", "end", mark_peak(F.col("peak"), threshold).alias("peak"))
    frames = (
        explode_span(lifted, "start", "end", key)
        .groupBy(key, "frame")
        .agg(F.max("peak").alias("_lift"))
    )
    boosted = (
        scores.join(frames, [key, "frame"], "left")
        .withColumns(
            {
                score: F.greatest(F.col(score), F.col("_lift")),
                "is_manual": F.col("_lift").isNotNull(),
            }
        )
        .drop("_lift")
    )
    merged = incidents.select(key, "start", "end", "peak").unionByName(lifted)
    return boosted, merged


def flag_kind(score: Column, threshold: float, is_manual: Column, is_activity: Column) -> Column:
    """Review label of a frame: manual mark, then activity, then model, else monitoring."""
    flagged = score >= threshold
    return (
        F.when(flagged & is_manual, "MANUAL MARK")
        .when(flagged & is_activity, "HIGH ACTIVITY")
        .when(flagged, "AGGRESSION")
        .otherwise("monitoring")
    )


def incident_report(
    incidents: DataFrame, marks: DataFrame | None = None, fps: float = 30.0, key: str = "clip_id"
) -> DataFrame:
    """Incidents in frames and seconds; is_manual when a mark has exactly that span."""
    if marks is None:
        tagged = incidents.withColumn("is_manual", F.lit(False))
    else:
        spans = marks.select(key, "start", "end").distinct().withColumn("_mark", F.lit(True))
        tagged = incidents.join(spans, [key, "start", "end"], "left").withColumn(
            "is_manual", F.coalesce("_mark", F.lit(False))
        )
    return tagged.select(
        key,
        "start",
        "end",
        seconds(F.col("start"), fps).alias("start_s"),
        seconds(F.col("end"), fps).alias("end_s"),
        "peak",
        "is_manual",
    )


def timeline(
    scores: DataFrame, threshold: float, fps: float = 30.0, key: str = "clip_id"
) -> DataFrame:
    """Rows behind the review plot: time, score, activity, flag. NaN counts as no score."""
    activity = F.col("activity") if "activity" in scores.columns else F.lit(None).cast("double")
    return scores.select(
        key,
        "frame",
        seconds(F.col("frame"), fps).alias("t"),
        "score",
        activity.alias("activity"),
        ((F.col("score") >= threshold) & ~F.isnan("score")).alias("flagged"),
    )


# --- matching ---------------------------------------------------------------------------


def _scale(length: Column) -> Column:
    """Power-of-two size class of an interval length, from its bit count (no rounding)."""
    return (F.length(F.bin(F.greatest(length, F.lit(1)).cast("bigint"))) - 1).cast("int")


def matched_truth(
    predicted: DataFrame, truth: DataFrame, iou_threshold: float = 0.5, key: str = "clip_id"
) -> DataFrame:
    """Distinct-id ground-truth intervals that some prediction matches.

    Intervals whose overlap ratio reaches the threshold differ in length by at most its
    inverse and overlap, so both sides meet in cells of the truth's own size class: the
    join key is (stream, size class, cell), never the bare stream. ``truth`` needs a
    unique ``gt_id``.
    """
    spans = predicted.select(key, F.col("start").alias("_ps"), F.col("end").alias("_pe")).distinct()
    if iou_threshold <= 0:
        return truth.join(spans.select(key).distinct(), key, "left_semi")
    spread = math.ceil(math.log2(1.0 / iou_threshold)) + 1
    sized = truth.filter(F.col("end") > F.col("start")).withColumn(
        "_scale", _scale(F.col("end") - F.col("start"))
    )
    celled = sized.withColumn(
        "_cell",
        F.explode(
            F.expr("sequence(shiftright(start, _scale), shiftright(end - 1, _scale))")
        ),
    )
    classes = spans.filter(F.col("_pe") > F.col("_ps")).withColumn(
        "_own", _scale(F.col("_pe") - F.col("_ps"))
    )
    offered = (
        classes.withColumn(
            "_scale",
            F.explode(F.expr(f"sequence(greatest(_own - {spread}, 0), least(_own + {spread}, 31))")),
        )
        .withColumn(
            "_cell",
            F.explode(F.expr("sequence(shiftright(_ps, _scale), shiftright(_pe - 1, _scale))")),
        )
        .select(F.col(key).alias("_pk"), F.col("_scale").alias("_pscale"), F.col("_cell").alias("_pcell"), "_ps", "_pe")
    )
    ratio = temporal_iou(F.col("start"), F.col("end"), F.col("_ps"), F.col("_pe"))
    hits = celled.join(
        offered,
        (celled[key] == F.col("_pk"))
        & (celled["_scale"] == F.col("_pscale"))
        & (celled["_cell"] == F.col("_pcell"))
        & (ratio >= iou_threshold),
        "left_semi",
    )
    return hits.drop("_scale", "_cell").dropDuplicates(["gt_id"])


def match_counts(
    predicted: DataFrame, truth: DataFrame, iou_threshold: float = 0.5, key: str = "clip_id"
) -> DataFrame:
    """Per stream: ground-truth incidents, matched ones, and recall."""
    hits = matched_truth(predicted, truth, iou_threshold, key).select("gt_id", F.lit(1).alias("_hit"))
    joined = truth.join(hits, "gt_id", "left")
    return joined.groupBy(key).agg(
        F.count("*").alias("truth"),
        F.count("_hit").alias("matched"),
        (F.count("_hit") / F.count("*")).alias("recall"),
    )
