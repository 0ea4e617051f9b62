"""The end-to-end review job."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog.adapters import SPINE, vector_clips, vector_poses
from kinetable.catalog.feature_queries import BIAS, WEIGHTS, _pair_sql
from kinetable.catalog.incident_queries import islands
from kinetable.catalog.registry import query, r6
from kinetable.catalog.signal_queries import ACTIVITY_PAIRS, MOTION, PRESSURE, STRIDE, WINDOW
from kinetable.config import ReviewConfig
from kinetable.operators.scoring import linear_scorer
from kinetable.plans import review as plan

CFG = ReviewConfig(
    window=WINDOW, stride=STRIDE, min_pair_height=370.0, max_gap=1, fps=6.0, smooth_seconds=0.5,
    baseline_seconds=0.5, motion_floor=0.1, motion_saturate=0.9, top_incidents=2, threshold=0.6,
)

_FRAMES = (
    _pair_sql(CFG.min_pair_height, ",", CFG.max_pairs)
    + ",".join(part.strip() for part in (SPINE, MOTION, PRESSURE, ACTIVITY_PAIRS))
    + f""",
mf AS (SELECT spine.clip_id, spine.frame, coalesce(avg(ws.prob), 0) AS model FROM spine
       LEFT JOIN ws ON ws.clip_id = spine.clip_id AND spine.frame >= ws.start AND spine.frame < ws."end" GROUP BY 1, 2),
mp AS (SELECT * FROM (SELECT spine.clip_id, spine.frame, ws.i, ws.jj,
              row_number() OVER (PARTITION BY spine.clip_id, spine.frame ORDER BY ws.prob DESC, ws.start) AS k
              FROM spine JOIN ws ON ws.clip_id = spine.clip_id AND spine.frame >= ws.start AND spine.frame < ws."end") WHERE k = 1),
en AS (SELECT spine.clip_id, spine.frame, coalesce(max(pm.motion), 0) AS energy FROM spine LEFT JOIN pm USING (clip_id, frame) GROUP BY 1, 2),
ac AS (SELECT en.clip_id, en.frame,
              sum(energy) OVER (PARTITION BY en.clip_id ORDER BY en.frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0 AS sm,
              greatest(pressure - quantile_cont(pressure, 0.5) OVER (PARTITION BY en.clip_id ORDER BY en.frame
                       ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) AS spike
       FROM en JOIN pressure USING (clip_id, frame)),
fr AS (SELECT ac.clip_id, ac.frame, mf.model, spike,
              greatest(least(greatest((sm - 0.1) / 0.8, 0), 1) * 0.9, least(greatest(spike * 1.5, 0), 0.99)) AS activity
       FROM ac JOIN mf ON mf.clip_id = ac.clip_id AND mf.frame = ac.frame),
rv AS (SELECT fr.clip_id, fr.frame, fr.model, fr.activity, fr.spike, fr.activity > fr.model AS is_activity,
              greatest(fr.activity, fr.model) AS score,
              CASE WHEN fr.activity > fr.model AND ap.i IS NOT NULL THEN ap.i ELSE mp.i END AS i,
              CASE WHEN fr.activity > fr.model AND ap.i IS NOT NULL THEN ap.j ELSE mp.jj END AS j
       FROM fr LEFT JOIN ap ON ap.clip_id = fr.clip_id AND ap.frame = fr.frame
               LEFT JOIN mp ON mp.clip_id = fr.clip_id AND mp.frame = fr.frame)
"""
)
_INCIDENTS = (
    ", rsc AS (SELECT clip_id, frame, score FROM rv),"
    + islands("inc", 1, 0.6, 1, "rsc").strip()
    + ", rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY peak DESC, start) AS k FROM inc)"
)


def _review(spark, sf):
    return plan.review(
        vector_poses(spark, sf), vector_clips(spark, sf), linear_scorer(WEIGHTS, BIAS), CFG, level="pooled"
    )


@query(
    "review_frames",
    _FRAMES
    + """SELECT clip_id, frame, round(model, 6) AS model, round(activity, 6) AS activity, round(score, 6) AS score,
                is_activity, coalesce(i, -1) AS i, coalesce(j, -1) AS j FROM rv""",
)
def review_frames(spark, sf):
    frames = plan.review_frames(
        vector_poses(spark, sf), vector_clips(spark, sf), linear_scorer(WEIGHTS, BIAS), CFG, level="pooled"
    )
    return frames.select(
        "clip_id", "frame", r6("model"), r6("activity"), r6("score"), "is_activity",
        F.coalesce("pair.i", F.lit(-1)).alias("i"), F.coalesce("pair.j", F.lit(-1)).alias("j"),
    )


@query(
    "review_incidents",
    _FRAMES + _INCIDENTS + ' SELECT clip_id, start, "end", round(peak, 6) AS peak FROM rk WHERE k <= 2',
)
def review_incidents(spark, sf):
    return _review(spark, sf).incidents.select("clip_id", "start", "end", r6("peak"))


@query(
    "review_kinds",
    _FRAMES + _INCIDENTS
    + """ SELECT rv.clip_id, rv.frame, round(CASE WHEN d.clip_id IS NOT NULL THEN least(score, 0.54) ELSE score END, 6) AS score,
                 CASE WHEN d.clip_id IS NOT NULL OR score < 0.6 THEN 'monitoring' WHEN is_activity THEN 'HIGH ACTIVITY' ELSE 'AGGRESSION' END AS kind
          FROM rv LEFT JOIN (SELECT * FROM rk WHERE k > 2) d ON d.clip_id = rv.clip_id AND rv.frame >= d.start AND rv.frame < d."end" """,
)
def review_kinds(spark, sf):
    return _review(spark, sf).frames.select("clip_id", "frame", r6("score"), "kind")


@query(
    "review_trigger",
    _FRAMES + _INCIDENTS
    + """, pk AS (SELECT * FROM (SELECT clip_id, frame AS peak_frame, spike, row_number() OVER (PARTITION BY clip_id ORDER BY spike DESC, frame) AS k FROM rv)
                  WHERE k = 1 AND spike > 0)
          SELECT clip_id, peak_frame, cast(greatest(start - 6, 0) AS int) AS start, cast(least("end" + 6, num_frames) AS int) AS "end", round(peak, 6) AS peak
          FROM (SELECT rk.clip_id, rk.start, rk."end", rk.peak, pk.peak_frame, row_number() OVER (PARTITION BY rk.clip_id ORDER BY start) AS m
                FROM rk JOIN pk USING (clip_id) WHERE rk.k <= 2 AND start < peak_frame) JOIN clips USING (clip_id) WHERE m = 1""",
)
def review_trigger(spark, sf):
    return _review(spark, sf).trigger.select("clip_id", "peak_frame", "start", "end", r6("peak"))
