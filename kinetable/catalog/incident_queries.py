"""Incident building, ranking, marks and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog.adapters import (
    LONG_SCORE_STREAMS,
    SCORE_STREAMS,
    STREAM_CLIPS,
    long_score_streams,
    score_streams,
    stream_clips,
)
from kinetable.catalog.registry import query, r6, with_tables
from kinetable.catalog.signal_queries import BASELINE
from kinetable.operators import incidents as inc
from kinetable.operators import signals

THRESHOLD, GAP, FPS = 0.5, 1, 30.0


def islands(name: str, window: int, threshold: float, gap: int, source: str = "fs") -> str:
    return f"""
{name}_hot AS (SELECT clip_id, frame AS s, frame + {window} AS e, score FROM {source} WHERE score >= {threshold}),
{name}_m AS (SELECT *, max(e) OVER (PARTITION BY clip_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {name}_hot),
{name}_k AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + {gap} THEN 1 ELSE 0 END)
             OVER (PARTITION BY clip_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {name}_m),
{name} AS (SELECT clip_id, cast(min(s) AS int) AS start, cast(max(e) AS int) AS "end", max(score) AS peak
           FROM {name}_k GROUP BY clip_id, island)"""


INCIDENTS = islands("inc", 1, THRESHOLD, GAP)
_ROUNDED = 'SELECT clip_id, start, "end", round(peak, 6) AS peak FROM '


def base_incidents(spark, sf):
    return inc.find_incidents(score_streams(spark, sf), 1, THRESHOLD, GAP, start="frame")


def _rounded(df):
    return df.select("clip_id", "start", "end", r6("peak"))


@query("incidents", with_tables(SCORE_STREAMS, INCIDENTS) + _ROUNDED + "inc")
def incidents(spark, sf):
    return _rounded(base_incidents(spark, sf))


@query(
    "incidents_overlapping_windows",
    with_tables(SCORE_STREAMS, islands("wide", 8, 0.9, 5)) + _ROUNDED + "wide",
)
def incidents_overlapping_windows(spark, sf):
    return _rounded(inc.find_incidents(score_streams(spark, sf), 8, 0.9, 5, start="frame"))


@query("long_incidents", with_tables(LONG_SCORE_STREAMS, INCIDENTS) + _ROUNDED + "inc")
def long_incidents(spark, sf):
    return _rounded(inc.find_incidents(long_score_streams(spark, sf), 1, THRESHOLD, GAP, start="frame"))


TOP = """
ranked AS (SELECT *, cast(row_number() OVER (PARTITION BY clip_id ORDER BY peak DESC, start) AS int) AS rank FROM inc)"""


@query("incidents_top_k", with_tables(SCORE_STREAMS, INCIDENTS, TOP) + _ROUNDED + "ranked WHERE rank <= 3")
def incidents_top_k(spark, sf):
    return _rounded(inc.rank_incidents(base_incidents(spark, sf), 3))


@query(
    "incidents_demoted_scores",
    with_tables(SCORE_STREAMS, INCIDENTS, TOP)
    + """SELECT fs.clip_id, fs.frame, round(CASE WHEN r.clip_id IS NOT NULL THEN least(score, 0.45) ELSE score END, 6) AS score
         FROM fs LEFT JOIN (SELECT * FROM ranked WHERE rank > 3) r
           ON r.clip_id = fs.clip_id AND fs.frame >= r.start AND fs.frame < r."end" """,
)
def incidents_demoted_scores(spark, sf):
    scores = score_streams(spark, sf)
    adjusted, _ = inc.keep_top_incidents(scores, base_incidents(spark, sf), THRESHOLD, 3)
    return adjusted.select("clip_id", "frame", r6("score"))


@query(
    "incident_trigger",
    with_tables(SCORE_STREAMS, STREAM_CLIPS, INCIDENTS)
    + f""", sp AS (SELECT clip_id, frame, greatest(score - quantile_cont(score, 0.5) OVER (PARTITION BY clip_id
            ORDER BY frame ROWS BETWEEN {BASELINE} PRECEDING AND CURRENT ROW), 0) AS spike FROM fs),
         pk AS (SELECT clip_id, frame AS peak_frame FROM (
           SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY spike DESC, frame) AS k FROM sp) WHERE k = 1 AND spike > 0)
         SELECT clip_id, peak_frame, cast(greatest(start - 3, 0) AS int) AS start,
                cast(least("end" + 3, num_frames) AS int) AS "end", round(peak, 6) AS peak
         FROM (SELECT inc.*, peak_frame, row_number() OVER (PARTITION BY inc.clip_id ORDER BY start) AS k
               FROM inc JOIN pk USING (clip_id) WHERE start < peak_frame) JOIN clips USING (clip_id) WHERE k = 1""",
)
def incident_trigger(spark, sf):
    spikes = signals.pressure_spikes(score_streams(spark, sf), "score", BASELINE)
    found = inc.earliest_before(
        base_incidents(spark, sf), signals.convergence_peak(spikes), stream_clips(spark, sf), pad=3
    )
    return found.select("clip_id", "peak_frame", "start", "end", r6("peak"))


MARKS = """
marks AS (SELECT clip_id, cast(hash_s AS varchar) || '.5-' || cast(hash_s + 2 AS varchar) AS mark
          FROM (SELECT clip_id, cast(clip_id AS bigint) % 3 AS hash_s FROM clips)),
spans AS (SELECT * FROM (
  SELECT clip_id, cast(greatest(trunc(cast(split_part(mark, '-', 1) AS double) * 10), 0) AS int) AS start,
         cast(least(trunc(cast(split_part(mark, '-', 2) AS double) * 10), num_frames) AS int) AS "end", 0.0 AS peak
  FROM marks JOIN clips USING (clip_id)) WHERE "end" > start)"""


def marks(spark, sf):
    second = F.col("clip_id").cast("bigint") % 3
    mark = F.concat(second.cast("string"), F.lit(".5-"), (second + 2).cast("string"))
    return stream_clips(spark, sf).select("clip_id", mark.alias("mark"))


def mark_spans(spark, sf):
    return inc.parse_marks(marks(spark, sf), stream_clips(spark, sf), fps=10.0)


@query("manual_mark_spans", with_tables(STREAM_CLIPS, MARKS) + 'SELECT clip_id, start, "end" FROM spans')
def manual_mark_spans(spark, sf):
    return mark_spans(spark, sf).select("clip_id", "start", "end")


@query(
    "manual_marks",
    with_tables(SCORE_STREAMS, STREAM_CLIPS, INCIDENTS, MARKS)
    + """SELECT clip_id, start, "end", round(peak, 6) AS peak FROM inc
         UNION ALL SELECT clip_id, start, "end", 0.51 FROM spans""",
)
def manual_marks(spark, sf):
    scores = score_streams(spark, sf)
    _, merged = inc.add_marks(scores, base_incidents(spark, sf), mark_spans(spark, sf), THRESHOLD)
    return _rounded(merged)


@query(
    "manual_mark_scores",
    with_tables(SCORE_STREAMS, STREAM_CLIPS, MARKS)
    + """SELECT fs.clip_id, fs.frame, round(CASE WHEN sp.clip_id IS NOT NULL THEN greatest(score, 0.51) ELSE score END, 6) AS score,
                sp.clip_id IS NOT NULL AS is_manual
         FROM fs LEFT JOIN spans sp ON sp.clip_id = fs.clip_id AND fs.frame >= sp.start AND fs.frame < sp."end" """,
)
def manual_mark_scores(spark, sf):
    scores = score_streams(spark, sf)
    lifted, _ = inc.add_marks(scores, base_incidents(spark, sf), mark_spans(spark, sf), THRESHOLD)
    return lifted.select("clip_id", "frame", r6("score"), "is_manual")


@query(
    "incident_report",
    with_tables(SCORE_STREAMS, STREAM_CLIPS, INCIDENTS, MARKS)
    + f""", al AS (SELECT clip_id, start, "end", peak FROM inc UNION ALL SELECT clip_id, start, "end", 0.51 FROM spans)
         SELECT al.clip_id, al.start, al."end", round(al.start/{FPS}, 6) AS start_s, round(al."end"/{FPS}, 6) AS end_s,
                round(al.peak, 6) AS peak, sp.clip_id IS NOT NULL AS is_manual
         FROM al LEFT JOIN spans sp ON sp.clip_id = al.clip_id AND sp.start = al.start AND sp."end" = al."end" """,
)
def incident_report(spark, sf):
    scores, spans = score_streams(spark, sf), mark_spans(spark, sf)
    _, merged = inc.add_marks(scores, base_incidents(spark, sf), spans, THRESHOLD)
    report = inc.incident_report(merged, spans, FPS)
    return report.select("clip_id", "start", "end", r6("start_s"), r6("end_s"), r6("peak"), "is_manual")


@query(
    "timeline",
    with_tables(SCORE_STREAMS)
    + f"""SELECT clip_id, frame, round(frame/{FPS}, 6) AS t, round(score, 6) AS score, score >= 0.5 AS flagged FROM fs""",
)
def timeline(spark, sf):
    rows = inc.timeline(score_streams(spark, sf), THRESHOLD, FPS)
    return rows.select("clip_id", "frame", r6("t"), r6("score"), "flagged")


SHIFTED = 'shifted AS (SELECT clip_id, start + 1 AS start, "end" + 1 AS "end" FROM inc)'


def _truth(spark, sf):
    """Stricter incidents with an id: the ground truth that looser ones are matched against."""
    found = inc.find_incidents(score_streams(spark, sf), 8, 0.9, 5, start="frame")
    return found.withColumn("gt_id", F.concat_ws(":", "clip_id", "start"))


@query(
    "iou_matches",
    with_tables(SCORE_STREAMS, islands("gt", 8, 0.9, 5), islands("pr", 8, 0.85, 2))
    + """SELECT gt.clip_id, gt.start, gt."end" FROM gt WHERE EXISTS (
           SELECT 1 FROM pr WHERE pr.clip_id = gt.clip_id
             AND greatest(0, least(pr."end", gt."end") - greatest(pr.start, gt.start)) /
                 ((pr."end" - pr.start) + (gt."end" - gt.start)
                  - greatest(0, least(pr."end", gt."end") - greatest(pr.start, gt.start)))::double >= 0.5)""",
)
def iou_matches(spark, sf):
    predicted = inc.find_incidents(score_streams(spark, sf), 8, 0.85, 2, start="frame")
    return inc.matched_truth(predicted, _truth(spark, sf)).select("clip_id", "start", "end")


@query(
    "iou_match_counts",
    with_tables(SCORE_STREAMS, islands("gt", 8, 0.9, 5), islands("pr", 8, 0.85, 2))
    + """, hit AS (SELECT gt.clip_id, EXISTS (
           SELECT 1 FROM pr WHERE pr.clip_id = gt.clip_id
             AND greatest(0, least(pr."end", gt."end") - greatest(pr.start, gt.start)) /
                 ((pr."end" - pr.start) + (gt."end" - gt.start)
                  - greatest(0, least(pr."end", gt."end") - greatest(pr.start, gt.start)))::double >= 0.5) AS m FROM gt)
         SELECT clip_id, count(*) AS truth, count(*) FILTER (m) AS matched,
                round(count(*) FILTER (m) / count(*)::double, 6) AS recall FROM hit GROUP BY 1""",
)
def iou_match_counts(spark, sf):
    predicted = inc.find_incidents(score_streams(spark, sf), 8, 0.85, 2, start="frame")
    counts = inc.match_counts(predicted, _truth(spark, sf))
    return counts.select("clip_id", "truth", "matched", r6("recall"))
