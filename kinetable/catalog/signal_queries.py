"""Windows, score curves and per-frame signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog.adapters import (
    EVENT_CLIPS,
    EVENT_JOINTS,
    LONG_SCORE_STREAMS,
    LONG_STREAM_CLIPS,
    PERSON_STATS,
    SCORE_STREAMS,
    SPINE,
    STREAM_CLIPS,
    VECTOR_CLIPS,
    VECTOR_JOINTS,
    event_clips,
    event_poses,
    long_score_streams,
    long_stream_clips,
    score_streams,
    stream_clips,
    vector_clips,
    vector_poses,
)
from kinetable.catalog.registry import query, r6, with_tables
from kinetable.operators import people, signals, windows

WINDOW, STRIDE, SMOOTH, BASELINE = 8, 4, 5, 30

STARTS = f"""
last AS (SELECT clip_id, num_frames, greatest(num_frames - {WINDOW}, 0) AS last FROM clips),
starts AS (
  SELECT DISTINCT clip_id, cast(s AS int) AS start, cast(least(s + {WINDOW}, num_frames) AS int) AS "end"
  FROM (SELECT clip_id, num_frames, unnest(range(0, last + 1, {STRIDE})) AS s FROM last
        UNION ALL SELECT clip_id, num_frames, last FROM last))"""

WINDOW_SCORES = """
ws AS (SELECT s.clip_id, s.start, s."end", fs.score AS prob,
              {'i': cast(s.start % 3 AS int), 'j': cast(s.start % 3 + 1 AS int)} AS pair
       FROM starts s JOIN fs ON fs.clip_id = s.clip_id AND fs.frame = s.start)"""


def window_scores(spark, sf):
    """A score and a pair for every window: the score of the window's first frame."""
    starts = windows.window_starts(stream_clips(spark, sf), WINDOW, STRIDE)
    first = score_streams(spark, sf).select("clip_id", F.col("frame").alias("start"), F.col("score").alias("prob"))
    i = (F.col("start") % 3).cast("int")
    return starts.join(first, ["clip_id", "start"]).withColumn(
        "pair", F.struct(i.alias("i"), (i + 1).cast("int").alias("j"))
    )


@query("window_starts", with_tables(STREAM_CLIPS, STARTS) + "SELECT * FROM starts")
def window_starts(spark, sf):
    return windows.window_starts(stream_clips(spark, sf), WINDOW, STRIDE)


@query(
    "window_membership",
    with_tables(SCORE_STREAMS, STREAM_CLIPS, STARTS)
    + """SELECT s.clip_id, s.start, count(*) AS frames, round(sum(fs.score), 6) AS total
         FROM starts s JOIN fs ON fs.clip_id = s.clip_id AND fs.frame >= s.start AND fs.frame < s."end"
         GROUP BY 1, 2""",
)
def window_membership(spark, sf):
    placed = windows.assign_windows(score_streams(spark, sf), stream_clips(spark, sf), WINDOW, STRIDE)
    return (
        placed.groupBy("clip_id", "start")
        .agg(F.count("*").alias("frames"), F.sum("score").alias("total"))
        .select("clip_id", "start", "frames", r6("total"))
    )


@query(
    "frame_scores",
    with_tables(SCORE_STREAMS, STREAM_CLIPS, STARTS, WINDOW_SCORES)
    + """SELECT fs.clip_id, fs.frame, round(coalesce(avg(ws.prob), 0), 6) AS score
         FROM fs LEFT JOIN ws ON ws.clip_id = fs.clip_id AND fs.frame >= ws.start AND fs.frame < ws."end"
         GROUP BY 1, 2""",
)
def frame_scores(spark, sf):
    curve = signals.frame_scores(window_scores(spark, sf), stream_clips(spark, sf), WINDOW)
    return curve.select("clip_id", "frame", r6("score"))


@query(
    "frame_best_pair",
    with_tables(SCORE_STREAMS, STREAM_CLIPS, STARTS, WINDOW_SCORES)
    + """SELECT clip_id, frame, pair.i AS i, pair.j AS j FROM (
           SELECT fs.clip_id, fs.frame, ws.pair,
                  row_number() OVER (PARTITION BY fs.clip_id, fs.frame ORDER BY ws.prob DESC, ws.start) AS k
           FROM fs JOIN ws ON ws.clip_id = fs.clip_id AND fs.frame >= ws.start AND fs.frame < ws."end")
         WHERE k = 1""",
)
def frame_best_pair(spark, sf):
    curve = signals.frame_scores(window_scores(spark, sf), stream_clips(spark, sf), WINDOW)
    return curve.select("clip_id", "frame", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))


@query(
    "moving_average",
    with_tables(SCORE_STREAMS)
    + f"""SELECT clip_id, frame, round(sum(score) OVER (PARTITION BY clip_id ORDER BY frame
            ROWS BETWEEN {SMOOTH // 2} PRECEDING AND {(SMOOTH - 1) // 2} FOLLOWING) / {SMOOTH}.0, 6) AS smooth FROM fs""",
)
def moving_average(spark, sf):
    return signals.moving_average(score_streams(spark, sf), "score", SMOOTH).select(
        "clip_id", "frame", r6("smooth")
    )


@query(
    "pressure_spikes",
    with_tables(SCORE_STREAMS)
    + f"""SELECT clip_id, frame, round(greatest(score - quantile_cont(score, 0.5) OVER (PARTITION BY clip_id
            ORDER BY frame ROWS BETWEEN {BASELINE} PRECEDING AND CURRENT ROW), 0), 6) AS spike FROM fs""",
)
def pressure_spikes(spark, sf):
    return signals.pressure_spikes(score_streams(spark, sf), "score", BASELINE).select(
        "clip_id", "frame", r6("spike")
    )


@query(
    "minmax_signal",
    with_tables(SCORE_STREAMS)
    + """SELECT clip_id, frame, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 6) AS scaled
         FROM (SELECT *, min(score) OVER (PARTITION BY clip_id) AS lo, max(score) OVER (PARTITION BY clip_id) AS hi FROM fs)""",
)
def minmax_signal(spark, sf):
    return signals.normalize_signal(score_streams(spark, sf), "score").select(
        "clip_id", "frame", r6("scaled")
    )


@query(
    "activity_curve",
    with_tables(SCORE_STREAMS)
    + f"""SELECT clip_id, frame, round(greatest(least(greatest((m - 0.3) / 0.4, 0), 1) * 0.9,
              least(greatest((score - med) * 1.5, 0), 0.99)), 6) AS activity
          FROM (SELECT *, sum(score) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS m,
                quantile_cont(score, 0.5) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN {BASELINE} PRECEDING AND CURRENT ROW) AS med
                FROM fs)""",
)
def activity_curve(spark, sf):
    smooth = signals.moving_average(score_streams(spark, sf), "score", SMOOTH)
    spiked = signals.pressure_spikes(smooth, "score", BASELINE)
    curve = signals.activity_curve(F.col("smooth"), F.col("spike"), motion_floor=0.3, motion_saturate=0.7)
    return spiked.withColumn("activity", curve).select("clip_id", "frame", r6("activity"))


@query(
    "convergence_peak",
    with_tables(SCORE_STREAMS)
    + f""", sp AS (SELECT clip_id, frame, greatest(score - quantile_cont(score, 0.5) OVER (PARTITION BY clip_id
            ORDER BY frame ROWS BETWEEN {BASELINE} PRECEDING AND CURRENT ROW), 0) AS spike FROM fs)
         SELECT clip_id, frame AS peak_frame, round(spike, 6) AS peak_spike FROM (
           SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY spike DESC, frame) AS k FROM sp)
         WHERE k = 1 AND spike > 0""",
)
def convergence_peak(spark, sf):
    spikes = signals.pressure_spikes(score_streams(spark, sf), "score", BASELINE)
    return signals.convergence_peak(spikes).select("clip_id", "peak_frame", r6("peak_spike"))


@query(
    "skeleton_stats",
    with_tables(VECTOR_JOINTS, PERSON_STATS)
    + "SELECT clip_id, frame, person, cast(n AS int) AS n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(high - low, 6) AS height FROM stats",
)
def skeleton_stats(spark, sf):
    stats = people.person_stats(vector_poses(spark, sf)).withColumn("height", F.col("high") - F.col("low"))
    return stats.select("clip_id", "frame", "person", "n", r6("cx"), r6("cy"), r6("height"))


MOTION = """
st AS (
  SELECT a.clip_id, a.frame, a.person, count(*) AS k, avg(sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) AS d
  FROM pj a JOIN pj b ON a.clip_id = b.clip_id AND a.person = b.person AND a.j = b.j AND b.frame = a.frame - 1
  WHERE a.s > 0 AND b.s > 0 GROUP BY 1, 2, 3),
ht AS (SELECT clip_id, frame, person, greatest(max(y) - min(y), 8.0) AS h FROM pj WHERE s > 0 GROUP BY 1, 2, 3),
pm AS (
  SELECT p.clip_id, p.frame, p.person, CASE WHEN st.k >= 3 THEN st.d / ht.h ELSE 0.0 END AS motion
  FROM (SELECT DISTINCT clip_id, frame, person FROM pj) p
  LEFT JOIN st USING (clip_id, frame, person) LEFT JOIN ht USING (clip_id, frame, person))"""

PRESSURE = """
ph AS (SELECT clip_id, frame, person, cx, cy, greatest(high - low, 1.0) AS h FROM stats),
sc AS (SELECT clip_id, frame, quantile_cont(h, 0.5) AS scale FROM ph GROUP BY 1, 2),
nn AS (SELECT a.clip_id, a.frame, a.person, min(sqrt((a.cx-b.cx)**2 + (a.cy-b.cy)**2)) AS d
       FROM ph a JOIN ph b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.person <> b.person GROUP BY 1, 2, 3),
pr AS (SELECT clip_id, frame, avg(scale / (scale + d)) AS p FROM nn JOIN sc USING (clip_id, frame) GROUP BY 1, 2),
pressure AS (SELECT spine.clip_id, spine.frame, coalesce(p, 0.0) AS pressure
             FROM spine LEFT JOIN pr ON pr.clip_id = spine.clip_id AND pr.frame = spine.frame)"""


@query(
    "person_motion",
    with_tables(VECTOR_JOINTS, MOTION) + "SELECT clip_id, frame, person, round(motion, 6) AS motion FROM pm",
)
def person_motion(spark, sf):
    return signals.person_motion(vector_poses(spark, sf)).select("clip_id", "frame", "person", r6("motion"))


@query(
    "motion_energy",
    with_tables(VECTOR_JOINTS, MOTION) + "SELECT clip_id, frame, round(max(motion), 6) AS energy FROM pm GROUP BY 1, 2",
)
def motion_energy(spark, sf):
    motion = signals.person_motion(vector_poses(spark, sf))
    return signals.motion_energy(motion, vector_clips(spark, sf)).select("clip_id", "frame", r6("energy"))


@query(
    "crowd_pressure",
    with_tables(VECTOR_JOINTS, VECTOR_CLIPS, SPINE, PERSON_STATS, PRESSURE)
    + "SELECT clip_id, frame, round(pressure, 6) AS pressure FROM pressure",
)
def crowd_pressure(spark, sf):
    return people.crowd_pressure(people.person_stats(vector_poses(spark, sf)), vector_clips(spark, sf)).select(
        "clip_id", "frame", r6("pressure")
    )


@query(
    "motion_energy_events",
    with_tables(EVENT_JOINTS, MOTION) + "SELECT clip_id, frame, round(max(motion), 6) AS energy FROM pm GROUP BY 1, 2",
)
def motion_energy_events(spark, sf):
    motion = signals.person_motion(event_poses(spark, sf))
    return signals.motion_energy(motion, event_clips(spark, sf)).select("clip_id", "frame", r6("energy"))


@query(
    "crowd_pressure_events",
    with_tables(EVENT_JOINTS, EVENT_CLIPS, SPINE, PERSON_STATS, PRESSURE)
    + "SELECT clip_id, frame, round(pressure, 6) AS pressure FROM pressure",
)
def crowd_pressure_events(spark, sf):
    return people.crowd_pressure(people.person_stats(event_poses(spark, sf)), event_clips(spark, sf)).select(
        "clip_id", "frame", r6("pressure")
    )


WINDOW_PEOPLE = f"""
wf AS (
  SELECT s.clip_id, s.start, s."end" - s.start AS wf, st.* EXCLUDE (clip_id) FROM starts s
  JOIN stats st ON st.clip_id = s.clip_id AND st.frame >= s.start AND st.frame < s."end"),
wp AS (
  SELECT clip_id, start, person, sum(sx)/sum(n) AS cx, sum(sy)/sum(n) AS cy,
         greatest(max(high) - min(low), 1.0) AS h, quantile_cont(high - low, 0.5) FILTER (n >= 5) AS tall
  FROM wf GROUP BY 1, 2, 3 HAVING count(*) / any_value(wf)::double >= 0.3)"""

PAIRS = """
wsc AS (SELECT clip_id, start, quantile_cont(h, 0.5) AS scale FROM wp GROUP BY 1, 2),
wd AS (SELECT a.clip_id, a.start, a.person AS a, b.person AS b, a.tall AS ta, b.tall AS tb,
              sqrt((a.cx-b.cx)**2 + (a.cy-b.cy)**2) AS d
       FROM wp a JOIN wp b ON a.clip_id = b.clip_id AND a.start = b.start AND a.person <> b.person),
wn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, start, a ORDER BY d, b) AS k FROM wd) WHERE k = 1),
wk AS (SELECT wn.* FROM wn JOIN wsc USING (clip_id, start) WHERE d <= DSCALE * scale),
pairs0 AS (SELECT clip_id, start, least(a, b) AS i, greatest(a, b) AS j, min(d) AS d, min(a) AS first,
                  any_value(least(coalesce(ta, -1), coalesce(tb, -1))) AS shorter
           FROM wk GROUP BY 1, 2, 3, 4),
pairs AS (SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY clip_id, start ORDER BY d, first) AS int) AS rank
                         FROM pairs0) WHERE rank <= MAXPAIRS)"""


def pairs_sql(distance_scale: float = 2.5, max_pairs: int = 16) -> str:
    return PAIRS.replace("DSCALE", str(distance_scale)).replace("MAXPAIRS", str(max_pairs))


@query(
    "window_people",
    with_tables(VECTOR_JOINTS, VECTOR_CLIPS, STARTS, PERSON_STATS, WINDOW_PEOPLE)
    + "SELECT clip_id, start, person, round(cx, 6) AS cx, round(cy, 6) AS cy, round(h, 6) AS h, round(tall, 6) AS tall FROM wp",
)
def window_people(spark, sf):
    present = people.window_people(people.person_stats(vector_poses(spark, sf)), vector_clips(spark, sf), WINDOW, STRIDE)
    return present.select("clip_id", "start", "person", r6("cx"), r6("cy"), r6("h"), r6("tall"))


@query(
    "candidate_pairs",
    with_tables(VECTOR_JOINTS, VECTOR_CLIPS, STARTS, PERSON_STATS, WINDOW_PEOPLE, pairs_sql())
    + "SELECT clip_id, start, i, j, round(d, 6) AS d, rank FROM pairs",
)
def candidate_pairs(spark, sf):
    return people.candidate_pairs(people.person_stats(vector_poses(spark, sf)), vector_clips(spark, sf), WINDOW, STRIDE).select(
        "clip_id", "start", "i", "j", r6("d"), "rank"
    )


@query(
    "nearest_pairs_top2",
    with_tables(VECTOR_JOINTS, VECTOR_CLIPS, STARTS, PERSON_STATS, WINDOW_PEOPLE, pairs_sql(0.2, 2))
    + "SELECT clip_id, start, i, j, round(d, 6) AS d, rank FROM pairs",
)
def nearest_pairs_top2(spark, sf):
    found = people.candidate_pairs(
        people.person_stats(vector_poses(spark, sf)), vector_clips(spark, sf), WINDOW, STRIDE, max_pairs=2, distance_scale=0.2
    )
    return found.select("clip_id", "start", "i", "j", r6("d"), "rank")


@query(
    "pair_quality_gate",
    with_tables(VECTOR_JOINTS, VECTOR_CLIPS, STARTS, PERSON_STATS, WINDOW_PEOPLE, pairs_sql())
    + "SELECT clip_id, start, i, j, round(d, 6) AS d, rank FROM pairs WHERE shorter >= 370.0",
)
def pair_quality_gate(spark, sf):
    found = people.candidate_pairs(
        people.person_stats(vector_poses(spark, sf)), vector_clips(spark, sf), WINDOW, STRIDE, min_pair_height=370.0
    )
    return found.select("clip_id", "start", "i", "j", r6("d"), "rank")


ACTIVITY_PAIRS = """
dense AS (SELECT spine.clip_id, spine.frame, cast(r.m AS int) AS person FROM spine, range(16) r(m)),
sm AS (SELECT d.clip_id, d.frame, d.person, st.cx, st.cy,
              sum(coalesce(pm.motion, 0)) OVER (PARTITION BY d.clip_id, d.person ORDER BY d.frame
                  ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0 AS smooth
       FROM dense d LEFT JOIN pm USING (clip_id, frame, person) LEFT JOIN stats st USING (clip_id, frame, person)),
lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, frame ORDER BY smooth DESC, person DESC) AS k FROM sm)
         WHERE k = 1),
cand AS (SELECT l.clip_id, l.frame, l.person AS a, b.person AS b,
                row_number() OVER (PARTITION BY l.clip_id, l.frame
                  ORDER BY sqrt((l.cx-b.cx)**2 + (l.cy-b.cy)**2), b.person) AS k
         FROM lead l JOIN sm b ON b.clip_id = l.clip_id AND b.frame = l.frame AND b.person <> l.person
         WHERE l.smooth > 0 AND l.cx IS NOT NULL AND b.cx IS NOT NULL),
ap AS (SELECT spine.clip_id, spine.frame, least(a, b) AS i, greatest(a, b) AS j FROM spine
       LEFT JOIN cand ON cand.clip_id = spine.clip_id AND cand.frame = spine.frame AND cand.k = 1)"""


@query(
    "activity_pairs",
    with_tables(VECTOR_JOINTS, VECTOR_CLIPS, SPINE, PERSON_STATS, MOTION, ACTIVITY_PAIRS)
    + "SELECT clip_id, frame, coalesce(i, -1) AS i, coalesce(j, -1) AS j FROM ap",
)
def activity_pairs(spark, sf):
    poses, clips = vector_poses(spark, sf), vector_clips(spark, sf)
    rows = signals.person_frames(poses)
    found = signals.activity_pairs(rows.filter("n > 0"), rows, clips, smooth=3)
    return found.select(
        "clip_id",
        "frame",
        F.coalesce("pair.i", F.lit(-1)).alias("i"),
        F.coalesce("pair.j", F.lit(-1)).alias("j"),
    )


# --- the same operators on the larger derived inputs -------------------------------------


def _long_window_scores(spark, sf):
    starts = windows.window_starts(long_stream_clips(spark, sf), 64, 16)
    first = long_score_streams(spark, sf).select(
        "clip_id", F.col("frame").alias("start"), F.col("score").alias("prob")
    )
    return starts.join(first, ["clip_id", "start"])


LONG_STARTS = STARTS.replace(f"num_frames - {WINDOW}", "num_frames - 64").replace(
    f"s + {WINDOW}", "s + 64").replace(f"last + 1, {STRIDE}", "last + 1, 16")


@query(
    "long_moving_average",
    with_tables(LONG_SCORE_STREAMS)
    + """SELECT clip_id, frame, round(sum(score) OVER (PARTITION BY clip_id ORDER BY frame
            ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15.0, 6) AS smooth FROM fs""",
)
def long_moving_average(spark, sf):
    return signals.moving_average(long_score_streams(spark, sf), "score", 15).select(
        "clip_id", "frame", r6("smooth")
    )


@query(
    "long_pressure_spikes",
    with_tables(LONG_SCORE_STREAMS)
    + """SELECT clip_id, frame, round(greatest(score - quantile_cont(score, 0.5) OVER (PARTITION BY clip_id
            ORDER BY frame ROWS BETWEEN 300 PRECEDING AND CURRENT ROW), 0), 6) AS spike FROM fs""",
)
def long_pressure_spikes(spark, sf):
    return signals.pressure_spikes(long_score_streams(spark, sf), "score", 300).select(
        "clip_id", "frame", r6("spike")
    )


@query(
    "long_frame_scores",
    with_tables(LONG_SCORE_STREAMS, LONG_STREAM_CLIPS, LONG_STARTS)
    + """, ws AS (SELECT s.*, fs.score AS prob FROM starts s JOIN fs ON fs.clip_id = s.clip_id AND fs.frame = s.start),
         cov AS (SELECT clip_id, cast(unnest(range(start, "end")) AS int) AS frame, prob FROM ws)
         SELECT clip_id, frame, round(avg(prob), 6) AS score FROM cov GROUP BY 1, 2""",
)
def long_frame_scores(spark, sf):
    curve = signals.frame_scores(_long_window_scores(spark, sf), long_stream_clips(spark, sf), 64)
    return curve.select("clip_id", "frame", r6("score"))


@query(
    "candidate_pairs_events",
    with_tables(EVENT_JOINTS, EVENT_CLIPS, STARTS, PERSON_STATS, WINDOW_PEOPLE, pairs_sql())
    + "SELECT clip_id, start, i, j, round(d, 6) AS d, rank FROM pairs",
)
def candidate_pairs_events(spark, sf):
    stats = people.person_stats(event_poses(spark, sf))
    return people.candidate_pairs(stats, event_clips(spark, sf), WINDOW, STRIDE).select(
        "clip_id", "start", "i", "j", r6("d"), "rank"
    )
