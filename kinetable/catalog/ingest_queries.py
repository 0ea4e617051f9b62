"""Clip names, bodies, annotations, detections, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable import dims
from kinetable.catalog.adapters import (
    SPINE,
    VECTOR_CLIPS,
    VECTOR_JOINTS,
    table,
    vector_clips,
    vector_poses,
)
from kinetable.catalog.feature_queries import long_joints
from kinetable.catalog.registry import query, r6, with_tables
from kinetable.operators import ingest, tracking
from kinetable.session import scratch_path
from kinetable.sources.depth import parse_clip_name
from kinetable.sources.keypoints import read_keypoint_json
from kinetable.sources.tables import clip_key, read_clips, read_poses, write_clips

CLIP_ID = "concat('clip_', lpad(cast(vec_id div 40 AS string), 6, '0'))"


@query(
    "clip_name_decode",
    """SELECT p_partkey, cast(p_partkey % 32 AS int) AS setup, cast(p_partkey % 3 AS int) AS camera,
              cast(p_partkey % 106 AS int) AS performer, cast(p_partkey % 2 AS int) AS replication,
              cast(p_partkey % 120 AS int) AS action FROM part""",
)
def clip_name_decode(spark, sf):
    name = "format_string('S%03dC%03dP%03dR%03dA%03d', p_partkey % 32, p_partkey % 3, p_partkey % 106, p_partkey % 2, p_partkey % 120)"
    named = table(spark, sf, "part").select("p_partkey", F.expr(name).alias("name"))
    return parse_clip_name(named, "name").drop("name")


_KEEP = ",".join(str(a) for a in dims.depth_action_ids("aggressive"))


@query("class_filter", f"SELECT p_partkey FROM part WHERE p_partkey % 120 IN ({_KEEP})")
def class_filter(spark, sf):
    action = (F.col("p_partkey") % 120).cast("int")
    return table(spark, sf, "part").filter(action.isin(dims.depth_action_ids("aggressive"))).select("p_partkey")


@query(
    "frame_path_split",
    """SELECT doc_id, CASE WHEN instr(source, '/') > 0 THEN source ELSE 'set/' || source END || '/clip_' || cast(doc_id % 50 AS varchar) AS clip,
              cast(doc_id // 50 AS int) AS frame FROM documents""",
)
def frame_path_split(spark, sf):
    folder = F.when(F.col("source").contains("/"), F.col("source")).otherwise(
        F.concat(F.lit("set\\"), F.col("source"))
    )
    named = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(folder, F.lit("\\clip_"), F.expr("cast(doc_id % 50 AS string)"), F.lit("/"),
                 F.expr("cast(doc_id div 50 AS string)"), F.lit(".png")).alias("path"),
    )
    return ingest.split_frame_path(named, "path").select("doc_id", "clip", "frame")


# --- depth bodies: three bodies per clip, the first one listed twice in every frame --------------


def depth_bodies(spark, sf):
    joints = F.expr(
        "transform(sequence(0, 24), j -> struct("
        "CASE WHEN (vec_id + j) % 97 = 0 THEN double('NaN') ELSE cast(embedding[j] AS double) END AS x,"
        "cast(embedding[j + 25] AS double) AS y,"
        "CASE WHEN (vec_id + j) % 11 = 0 THEN 0.0D ELSE cast(embedding[(j + 50) % 64] AS double) + 2 END AS z,"
        "CASE WHEN (vec_id + j) % 13 = 0 THEN double('NaN') ELSE cast(embedding[j] AS double)*1000 END AS color_x,"
        "cast(embedding[j + 1] AS double)*1000 AS color_y))"
    )
    return table(spark, sf, "embeddings").select(
        F.expr(CLIP_ID).alias("clip_id"),
        F.expr("cast((vec_id % 40) div 4 AS int)").alias("frame"),
        F.expr("cast(vec_id % 4 AS int)").alias("pos"),
        F.expr("cast((vec_id % 4) % 3 AS string)").alias("body_id"),
        joints.alias("joints"),
    )


BODIES = """
bj AS (
  SELECT 'clip_' || lpad(cast(vec_id//40 AS varchar), 6, '0') AS clip_id, cast((vec_id%40)//4 AS int) AS frame,
         cast(vec_id%4 AS int) AS pos, cast((vec_id%4)%3 AS varchar) AS body_id, cast(r.j AS int) AS j,
         CASE WHEN (vec_id + r.j) % 97 = 0 THEN NULL ELSE cast(embedding[r.j+1] AS double) END AS x,
         cast(embedding[r.j+26] AS double) AS y,
         CASE WHEN (vec_id + r.j) % 11 = 0 THEN 0.0 ELSE cast(embedding[(r.j+50)%64+1] AS double) + 2 END AS z,
         CASE WHEN (vec_id + r.j) % 13 = 0 THEN NULL ELSE cast(embedding[r.j+1] AS double)*1000 END AS cx,
         cast(embedding[r.j+2] AS double)*1000 AS cy
  FROM embeddings, range(25) r(j)),
bl AS (SELECT * FROM bj WHERE pos = (SELECT max(pos) FROM bj b2 WHERE b2.clip_id = bj.clip_id AND b2.frame = bj.frame AND b2.body_id = bj.body_id)),
okf AS (SELECT clip_id, frame, body_id FROM bl GROUP BY 1, 2, 3 HAVING count(x) = 25),
bm AS (SELECT clip_id, body_id, sum(v) AS motion FROM (
         SELECT bl.clip_id, bl.body_id, j, var_pop(x) + var_pop(y) + var_pop(z) AS v
         FROM bl JOIN okf USING (clip_id, frame, body_id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
ball AS (SELECT clip_id, body_id, min(frame*1000 + CASE WHEN body_id = '0' THEN 0 ELSE pos END) AS seen FROM bl GROUP BY 1, 2),
br AS (SELECT ball.clip_id, ball.body_id, coalesce(motion, 0.0) AS motion,
              cast(row_number() OVER (PARTITION BY ball.clip_id ORDER BY coalesce(motion, 0.0) DESC, seen) - 1 AS int) AS slot
       FROM ball LEFT JOIN bm USING (clip_id, body_id))"""

BODIES = BODIES.replace(
    "WHERE pos = (SELECT max(pos) FROM bj b2 WHERE b2.clip_id = bj.clip_id AND b2.frame = bj.frame AND b2.body_id = bj.body_id)",
    "QUALIFY pos = max(pos) OVER (PARTITION BY clip_id, frame, body_id)",
)


@query(
    "body_motion_rank",
    with_tables(BODIES) + "SELECT clip_id, body_id, round(motion, 6) AS motion, slot FROM br WHERE slot < 2",
)
def body_motion_rank(spark, sf):
    ranked = ingest.rank_bodies(ingest.body_motion(ingest.last_bodies(depth_bodies(spark, sf))))
    return ranked.select("clip_id", "body_id", r6("motion"), "slot")


_MAP = ",".join(f"({i},{s})" for i, s in enumerate(dims.DEPTH_TO_POSE))


def _pose_sql(x: str, y: str) -> str:
    return (
        with_tables(BODIES, f"mp(slot17, src) AS (VALUES {_MAP})")
        + f"""SELECT clip_id, frame, slot AS person, cast(slot17 AS int) AS j, round(coalesce(u, 0), 6) AS x, round(coalesce(v, 0), 6) AS y,
                     CASE WHEN slot17 BETWEEN 1 AND 4 OR u IS NULL OR v IS NULL THEN 0.0::double ELSE 1.0 END AS s
              FROM (SELECT bl.clip_id, bl.frame, br.slot, mp.slot17, {x} AS u, {y} AS v
                    FROM bl JOIN br USING (clip_id, body_id) JOIN mp ON mp.src = bl.j WHERE br.slot < 2)"""
    )


@query("body_poses_color", _pose_sql("cx", "cy"))
def body_poses_color(spark, sf):
    return long_joints(ingest.bodies_to_poses(depth_bodies(spark, sf)))


@query(
    "body_poses_projected",
    _pose_sql(
        "CASE WHEN abs(z) >= 1e-6 THEN 1100.0*x/z + 960.0 END",
        "CASE WHEN abs(z) >= 1e-6 THEN 540.0 - 1100.0*y/z END",
    ),
)
def body_poses_projected(spark, sf):
    return long_joints(ingest.bodies_to_poses(depth_bodies(spark, sf), mode="project"))


# --- keypoint annotations: four people per image, gaps between frame numbers -----------------------


def images(spark, sf):
    """One image per group of four vectors; every tenth id is listed twice, the last name counts."""
    ids = table(spark, sf, "embeddings").select(F.expr("vec_id div 4").alias("id")).distinct()
    name = (
        "concat(CASE WHEN id div 10 % 2 = 0 THEN 'root/punching' ELSE 'root/walk' END, '/clip_',"
        " lpad(cast(id div 10 AS string), 6, '0'), '/', cast(id % 10 * 3 + {shift} AS string), '.png')"
    )
    first = ids.select("id", F.expr(name.format(shift=0)).alias("file_name"), F.lit(0).alias("pos"))
    again = ids.filter(F.col("id") % 10 == 0).select(
        "id", F.expr(name.format(shift=1)).alias("file_name"), F.lit(1).alias("pos")
    )
    return first.unionByName(again).withColumn("source", F.lit("doc"))


def annotations(spark, sf):
    flat = (
        "flatten(transform(sequence(0, 16), j -> array(cast(embedding[2*j] AS double)*1000,"
        " cast(embedding[2*j+1] AS double)*1000, cast((vec_id + j) % 3 AS double))))"
    )
    score = "CASE WHEN vec_id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE round(cast(embedding[0] AS double), 1) END"
    rows = table(spark, sf, "embeddings").select(
        F.lit("doc").alias("source"),
        F.expr("(vec_id div 4) + (CASE WHEN vec_id % 41 = 0 THEN 1000000000 ELSE 0 END)").alias("image_id"),
        F.expr(flat).alias("keypoints"),
        F.expr(score).alias("score"),
        F.col("vec_id").alias("pos"),
    )
    return rows


ANNOTATIONS = """
im AS (SELECT id, CASE WHEN id//10%2 = 0 THEN 'root/punching' ELSE 'root/walk' END || '/clip_' || lpad(cast(id//10 AS varchar), 6, '0') AS clip,
              cast(id%10*3 + CASE WHEN id%10 = 0 THEN 1 ELSE 0 END AS int) AS raw
       FROM (SELECT DISTINCT vec_id//4 AS id FROM embeddings)),
an AS (SELECT vec_id, CASE WHEN vec_id%41 = 0 THEN NULL ELSE vec_id//4 END AS image_id, embedding,
              coalesce(CASE WHEN vec_id%5 = 0 THEN NULL ELSE round(cast(embedding[1] AS double), 1) END, 1.0) AS score FROM embeddings),
ap AS (SELECT * FROM (SELECT im.clip, im.raw, an.*, cast(row_number() OVER (PARTITION BY clip, raw ORDER BY score DESC, vec_id) - 1 AS int) AS person
                      FROM an JOIN im ON an.image_id = im.id) WHERE person < 2),
ad AS (SELECT *, cast(dense_rank() OVER (PARTITION BY clip ORDER BY raw) - 1 AS int) AS frame FROM ap)"""


@query(
    "topk_people_per_frame",
    with_tables(ANNOTATIONS) + "SELECT clip, frame, person, round(score, 6) AS score FROM ad",
)
def topk_people_per_frame(spark, sf):
    people = ingest.group_annotations(images(spark, sf), annotations(spark, sf))
    return people.select("clip", "frame", "person", r6("score"))


_ANNOTATION_JOINTS = """
SELECT clip AS clip_id, frame, person, cast(r.j AS int) AS j,
       round(CASE WHEN (vec_id+r.j)%3 > 0 THEN cast(embedding[2*r.j+1] AS double)*1000 ELSE 0 END, 6) AS x,
       round(CASE WHEN (vec_id+r.j)%3 > 0 THEN cast(embedding[2*r.j+2] AS double)*1000 ELSE 0 END, 6) AS y,
       round(((vec_id+r.j)%3)/2.0::double, 6) AS s
FROM ad, range(17) r(j)"""


@query("annotation_joints", with_tables(ANNOTATIONS) + _ANNOTATION_JOINTS)
def annotation_joints(spark, sf):
    people = ingest.group_annotations(images(spark, sf), annotations(spark, sf))
    return long_joints(people.withColumnRenamed("clip", "clip_id"))


@query(
    "first_clips_limit",
    with_tables(ANNOTATIONS)
    + "SELECT clip, frame, person FROM ad WHERE clip IN (SELECT DISTINCT clip FROM ap ORDER BY clip LIMIT 5)",
)
def first_clips_limit(spark, sf):
    people = ingest.group_annotations(images(spark, sf), annotations(spark, sf), limit=5)
    return people.select("clip", "frame", "person")


@query(
    "dense_frame_index",
    """WITH v AS (SELECT vec_id, vec_id//40 AS clip, vec_id * 7 % 4093 AS raw FROM embeddings)
       SELECT vec_id, cast(dense_rank() OVER (PARTITION BY clip ORDER BY raw) - 1 AS int) AS frame FROM v""",
)
def dense_frame_index(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.expr("vec_id div 40").alias("clip"), F.expr("vec_id * 7 % 4093").alias("raw")
    )
    return ingest.dense_frames(rows, "clip", "raw", "frame").select("vec_id", "frame")


@query("keypoint_document_source", with_tables(ANNOTATIONS) + _ANNOTATION_JOINTS)
def keypoint_document_source(spark, sf):
    """Images and annotations written as JSON documents by many tasks and read back.

    Objects of one image may end up in different files, so nothing may depend on their
    order: only the last name of an image is written, and equal scores are told apart by
    a step far below the rounding of the scores.
    """
    path = scratch_path(spark, "keypoints")
    named = images(spark, sf).filter((F.col("id") % 10 != 0) | (F.col("pos") == 1))
    scored = annotations(spark, sf).withColumn(
        "score", F.coalesce("score", F.lit(1.0)) - (F.col("pos") % 4) * 0.001
    )
    # Nested objects before and after the marks, with braces and quotes inside their strings.
    odd = F.struct(F.struct(F.lit('}{"').alias("text")).alias("inner"))
    image = F.to_json(F.struct(odd.alias("meta"), "id", "file_name"))
    note = F.to_json(F.struct(odd.alias("seg"), "image_id", "keypoints", "score", odd.alias("more")))
    lines = named.select(F.concat(F.lit('{"info":{"v":"{"},"images":['), image, F.lit("]}")).alias("value"))
    lines.unionByName(
        scored.select(F.concat(F.lit('{"annotations":['), note, F.lit('],"images":[]}')).alias("value"))
    ).write.text(path)
    read_images, read_notes = read_keypoint_json(spark, path)
    people = ingest.group_annotations(
        read_images.withColumn("source", F.lit("doc")), read_notes.withColumn("source", F.lit("doc"))
    )
    return long_joints(people.withColumnRenamed("clip", "clip_id"))


# --- dense axes and tables -----------------------------------------------------------------------------


@query(
    "dense_slots",
    with_tables(VECTOR_JOINTS, VECTOR_CLIPS, SPINE)
    + """SELECT spine.clip_id, spine.frame, cast(m.m AS int) AS person, cast(r.j AS int) AS j,
                round(coalesce(pj.x, 0), 6) AS x, round(coalesce(pj.y, 0), 6) AS y, round(coalesce(pj.s, 0), 6) AS s
         FROM spine, range(6) m(m), range(17) r(j) LEFT JOIN pj ON pj.clip_id = spine.clip_id AND pj.frame = spine.frame
              AND pj.person = m.m AND pj.j = r.j""",
)
def dense_slots(spark, sf):
    # More slots than people, so that some are absent everywhere.
    return long_joints(ingest.densify(vector_poses(spark, sf), vector_clips(spark, sf), 6))


@query(
    "clip_tables_round_trip",
    with_tables(VECTOR_JOINTS, VECTOR_CLIPS)
    + """SELECT c.dataset, c.clip_id, any_value(c.num_frames) AS num_frames, count(*)//17 AS skeletons,
                round(sum(cast(x AS float)::double), 3) AS sum_x FROM clips c JOIN pj USING (clip_id) GROUP BY 1, 2""",
)
def clip_tables_round_trip(spark, sf):
    path = scratch_path(spark, "clips")
    named = vector_clips(spark, sf).withColumn("clip_id", clip_key("clip_id"))
    poses = vector_poses(spark, sf).join(named.select("clip_id", "dataset"), "clip_id")
    write_clips(named, poses, path)
    sums = F.aggregate("joints", F.lit(0.0), lambda acc, j: acc + j.x.cast("double"))
    per_clip = read_poses(spark, path).groupBy("dataset", "clip_id").agg(
        F.count("*").alias("skeletons"), F.round(F.sum(sums), 3).alias("sum_x")
    )
    return per_clip.join(read_clips(spark, path).select("clip_id", "num_frames"), "clip_id")


# --- detections ----------------------------------------------------------------------------------------


def detections(spark, sf):
    """Vectors as detections: every frame has up to four, some without confidences."""
    joints = F.expr(
        "transform(sequence(0, 16), j -> struct(cast(embedding[2*j] AS double)*1000 + 300*((vec_id*7)%4) AS x,"
        "cast(embedding[2*j+1] AS double)*1000 AS y,"
        "CASE WHEN j = 3 THEN CAST(NULL AS DOUBLE) ELSE greatest(cast(embedding[34+j] AS double)*5, 0.0D) END AS s))"
    )
    return table(spark, sf, "embeddings").select(
        F.expr(CLIP_ID).alias("clip_id"),
        F.expr("cast((vec_id % 40) div 4 AS int)").alias("frame"),
        F.expr("cast(vec_id % 4 AS int)").alias("det"),
        F.expr("CASE WHEN vec_id % 6 = 0 THEN CAST(NULL AS DOUBLE) ELSE round(abs(cast(embedding[60] AS double)), 1) END").alias("box_conf"),
        joints.alias("joints"),
    )


@query(
    "top_detections",
    """WITH d AS (SELECT 'clip_' || lpad(cast(vec_id//40 AS varchar), 6, '0') AS clip_id, cast((vec_id%40)//4 AS int) AS frame,
                         cast(vec_id%4 AS int) AS det,
                         coalesce(CASE WHEN vec_id%6 = 0 THEN NULL ELSE round(abs(cast(embedding[61] AS double)), 1) END, 1.0) AS box_conf
                  FROM embeddings)
       SELECT clip_id, frame, det, round(box_conf, 6) AS box_conf, rank FROM (
         SELECT *, cast(row_number() OVER (PARTITION BY clip_id, frame ORDER BY box_conf DESC, det DESC) - 1 AS int) AS rank FROM d)
       WHERE rank < 2""",
)
def top_detections(spark, sf):
    best = tracking.top_detections(tracking.with_default_confidence(detections(spark, sf)))
    return best.select("clip_id", "frame", "det", r6("box_conf"), "rank")


#: Slots of two people a frame, one frame after the other.
TRACKED = """
RECURSIVE d AS (
  SELECT 'clip_' || lpad(cast(vec_id//40 AS varchar), 6, '0') AS clip_id, cast((vec_id%40)//4 AS int) AS frame, cast(vec_id%4 AS int) AS det,
    coalesce(CASE WHEN vec_id%6 = 0 THEN NULL ELSE round(abs(cast(embedding[61] AS double)), 1) END, 1.0) AS conf,
    list_transform(range(0, 17), lambda j: {'x': cast(embedding[2*j+1] AS double)*1000 + 300*((vec_id*7)%4), 'y': cast(embedding[2*j+2] AS double)*1000,
      's': CASE WHEN j = 3 THEN 1.0 ELSE greatest(cast(embedding[35+j] AS double)*5, 0.0) END}) AS joints
  FROM embeddings),
best AS (SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY clip_id, frame ORDER BY conf DESC, det DESC) - 1 AS int) AS rank FROM d) WHERE rank < 2),
sure AS (SELECT *, list_filter(joints, lambda j: j.s > 0.1) AS seen FROM best),
c AS (
  SELECT clip_id, frame, rank, joints, list_avg(list_transform(joints, lambda j: j.x)) AS cx, list_avg(list_transform(joints, lambda j: j.y)) AS cy,
    list_avg(list_transform(CASE WHEN len(seen) > 0 THEN seen ELSE joints END, lambda j: j.x)) AS vx,
    list_avg(list_transform(CASE WHEN len(seen) > 0 THEN seen ELSE joints END, lambda j: j.y)) AS vy
  FROM sure),
f AS (
  SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS place, count(*) AS n,
    max(CASE WHEN rank = 0 THEN cx END) AS ax, max(CASE WHEN rank = 0 THEN cy END) AS ay, max(CASE WHEN rank = 0 THEN vx END) AS au, max(CASE WHEN rank = 0 THEN vy END) AS av,
    max(CASE WHEN rank = 1 THEN cx END) AS bx, max(CASE WHEN rank = 1 THEN cy END) AS b_y, max(CASE WHEN rank = 1 THEN vx END) AS bu, max(CASE WHEN rank = 1 THEN vy END) AS bv
  FROM c GROUP BY clip_id, frame),
steps AS (
  SELECT clip_id, 0::BIGINT AS place, -1 AS frame, 0 AS a_slot, NULL::DOUBLE AS x0, NULL::DOUBLE AS y0, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1 FROM f GROUP BY clip_id
  UNION ALL
  SELECT clip_id, place, frame, a_slot,
    CASE WHEN a_slot = 0 THEN au WHEN n = 2 THEN bu ELSE x0 END, CASE WHEN a_slot = 0 THEN av WHEN n = 2 THEN bv ELSE y0 END,
    CASE WHEN a_slot = 1 THEN au WHEN n = 2 THEN bu ELSE x1 END, CASE WHEN a_slot = 1 THEN av WHEN n = 2 THEN bv ELSE y1 END
  FROM (
    SELECT *, CASE WHEN x0 IS NULL AND x1 IS NULL THEN 0
      WHEN x1 IS NULL THEN CASE WHEN n = 1 OR a0 <= b0 THEN 0 ELSE 1 END
      WHEN n = 1 THEN CASE WHEN a0 <= a1 THEN 0 ELSE 1 END
      WHEN a0 = least(a0, a1, b0, b1) THEN 0 WHEN a1 = least(a0, a1, b0, b1) THEN 1 WHEN b0 = least(a0, a1, b0, b1) THEN 1 ELSE 0 END AS a_slot
    FROM (
      SELECT f.*, x0, y0, x1, y1, sqrt((ax-x0)**2 + (ay-y0)**2) AS a0, sqrt((ax-x1)**2 + (ay-y1)**2) AS a1,
        sqrt((bx-x0)**2 + (b_y-y0)**2) AS b0, sqrt((bx-x1)**2 + (b_y-y1)**2) AS b1
      FROM steps s JOIN f ON f.clip_id = s.clip_id AND f.place = s.place + 1))),
slots AS (SELECT c.clip_id, c.frame, c.rank, cast(CASE WHEN rank = 0 THEN a_slot ELSE 1 - a_slot END AS int) AS person, joints FROM c JOIN steps USING (clip_id, frame))"""


@query(
    "slot_tracking",
    with_tables(TRACKED) + "SELECT clip_id, frame, person, cast(len(joints) AS int) AS joints, round(joints[1].x, 6) AS x, round(joints[1].y, 6) AS y FROM slots",
)
def slot_tracking(spark, sf):
    tracked = tracking.track(detections(spark, sf), 2)
    first = F.col("joints")[0]
    tracked = tracked.withColumns({"x": first["x"], "y": first["y"], "joints": F.size("joints")})
    return tracked.select("clip_id", "frame", "person", "joints", r6("x"), r6("y"))
