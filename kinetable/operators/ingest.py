"""From raw skeletons to the pose model: body ranking, 2-D routes, keypoint mapping, densifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.dims import DEPTH_TO_POSE, FACE_SLOTS, FOCAL, NUM_JOINTS, PRINCIPAL_POINT
from kinetable.functions.numeric import clip
from kinetable.functions.text import base_name, parent, slashes
from kinetable.operators.chunks import attach_by_key, earlier, frame_spine, with_chunk

FLAT_DEPTH = 1e-6  # depths closer to zero than this cannot be projected (fixed value)


# --- depth-camera bodies -----------------------------------------------------------------


def last_bodies(bodies: DataFrame, key: str = "clip_id") -> DataFrame:
    """One row per (clip, frame, body): the last one listed wins."""
    return bodies.groupBy(key, "frame", "body_id").agg(
        F.max_by("joints", "pos").alias("joints"), F.min("pos").alias("pos")
    )


def body_motion(tracks: DataFrame, key: str = "clip_id") -> DataFrame:
    """Motion of each body: variance over time summed over joints and axes.

    Only frames whose joints are all known count; a body without such frames has motion 0.
    Also returns when the body was first seen and how many frames it has.
    """
    unknown = F.exists("joints", lambda j: F.isnan(j.x) | F.isnan(j.y) | F.isnan(j.z))
    seen = tracks.groupBy(key, "body_id").agg(
        F.min(F.struct("frame", "pos")).alias("first_seen"), F.count("*").alias("rows")
    )
    spread = (
        tracks.filter(~unknown)
        .select(key, "body_id", F.posexplode("joints").alias("j", "p"))
        .groupBy(key, "body_id", "j")
        .agg((F.var_pop("p.x") + F.var_pop("p.y") + F.var_pop("p.z")).alias("v"))
        .groupBy(key, "body_id")
        .agg(F.sum("v").alias("motion"))
    )
    return seen.join(spread, [key, "body_id"], "left").withColumn(
        "motion", F.coalesce("motion", F.lit(0.0))
    )


def rank_bodies(motion: DataFrame, max_bodies: int = 2, key: str = "clip_id") -> DataFrame:
    """The ``max_bodies`` liveliest bodies per clip with their slot; first seen wins ties."""
    order = Window.partitionBy(key).orderBy(F.col("motion").desc(), "first_seen")
    return (
        motion.withColumn("slot", F.row_number().over(order) - 1)
        .filter(F.col("slot") < max_bodies)
    )


def depth_point(joint: Column, mode: str) -> tuple[Column, Column]:
    """2-D coordinates of a depth joint, NaN where it cannot be placed."""
    if mode == "color":
        return joint["color_x"], joint["color_y"]
    if mode != "project":
        raise ValueError(f"unknown mode {mode!r}")
    flat = F.abs(joint["z"]) < FLAT_DEPTH
    z = F.when(flat, F.lit(float("nan"))).otherwise(joint["z"])
    return (
        F.lit(FOCAL[0]) * joint["x"] / z + F.lit(PRINCIPAL_POINT[0]),
        F.lit(PRINCIPAL_POINT[1]) - F.lit(FOCAL[1]) * joint["y"] / z,
    )


def depth_to_pose(joints: Column, mode: str = "color") -> Column:
    """25 depth joints -> 17 pose joints; unknown coordinates become 0 and score 0."""
    slots = []
    for slot, source in enumerate(DEPTH_TO_POSE):
        x, y = depth_point(joints[source], mode)
        known = F.lit(0.0) if slot in FACE_SLOTS else F.when(F.isnan(x) | F.isnan(y), 0.0).otherwise(1.0)
        slots.append(
            F.struct(
                F.nanvl(x, F.lit(0.0)).alias("x"), F.nanvl(y, F.lit(0.0)).alias("y"), known.alias("s")
            )
        )
    return F.array(*slots)


def bodies_to_poses(
    bodies: DataFrame, max_bodies: int = 2, mode: str = "color", key: str = "clip_id"
) -> DataFrame:
    """Tracked bodies -> (clip, frame, person, joints) of the kept bodies."""
    tracks = last_bodies(bodies, key).withColumn("_track", F.concat_ws("\u0001", key, "body_id"))
    kept = rank_bodies(body_motion(tracks, key), max_bodies, key).select(
        F.concat_ws("\u0001", key, "body_id").alias("_track"), "slot", "rows"
    )
    placed = attach_by_key(tracks, kept, "_track", "rows", ["frame"])
    return placed.select(
        key, "frame", F.col("slot").cast("int").alias("person"), depth_to_pose(F.col("joints"), mode).alias("joints")
    )


# --- keypoint annotations -------------------------------------------------------------------


def first_joints(flat: Column) -> Column:
    """Flat (x, y, v) list -> the first 17 joints; other lengths than whole joints are rejected."""
    joints = F.transform(
        F.sequence(F.lit(0), F.lit(NUM_JOINTS - 1)),
        lambda i: F.struct(
            flat[i * 3].cast("double").alias("x"),
            flat[i * 3 + 1].cast("double").alias("y"),
            flat[i * 3 + 2].cast("double").alias("v"),
        ),
    )
    usable = (F.size(flat) % 3 == 0) & (F.size(flat) >= NUM_JOINTS * 3)
    bad = F.raise_error(F.concat(F.lit("keypoint list of length "), F.size(flat).cast("string")))
    return F.when(usable, joints).otherwise(bad.cast("array<struct<x:double,y:double,v:double>>"))


def visible_joints(joints: Column) -> Column:
    """Visibility 0/1/2 -> score 0/0.5/1; invisible joints lose their coordinates."""
    return F.transform(
        joints,
        lambda j: F.struct(
            F.when(j.v > 0, j.x).otherwise(0.0).alias("x"),
            F.when(j.v > 0, j.y).otherwise(0.0).alias("y"),
            clip(j.v / 2.0, 0.0, 1.0).alias("s"),
        ),
    )


def split_frame_path(df: DataFrame, name: str) -> DataFrame:
    """``a/b/clip/12.png`` -> clip ``a/b/clip`` and frame 12."""
    path = slashes(F.col(name))
    number = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "").cast("int")
    return df.withColumns({"clip": parent(path), "frame": number})


def top_people(
    df: DataFrame, group: list[str], limit: int, score: str = "score", position: str = "pos"
) -> DataFrame:
    """Best-scored rows per group with their ``person`` slot; earlier position wins ties.

    Spark limits each map task to ``limit`` rows per group before it shuffles.
    """
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), position)
    return df.withColumn("person", F.row_number().over(order) - 1).filter(F.col("person") < limit)


def dense_frames(df: DataFrame, key: str = "clip", frame: str = "frame", out: str = "frame") -> DataFrame:
    """Frame numbers compacted to 0, 1, 2, ... per clip in their order.

    Ranks are taken inside chunks of frame numbers and shifted by the count of the
    earlier chunks.
    """
    chunked = with_chunk(df.withColumn("_f", F.col(frame)), "_f")
    counts = chunked.groupBy(key, "chunk").agg(F.count_distinct("_f").alias("_n"))
    base = counts.select(
        key,
        "chunk",
        F.coalesce(F.sum("_n").over(earlier(key)), F.lit(0)).alias("_base"),
    )
    rank = F.dense_rank().over(Window.partitionBy(key, "chunk").orderBy("_f"))
    ranked = chunked.withColumn("_rank", rank).join(base, [key, "chunk"])
    return ranked.withColumn(out, (F.col("_base") + F.col("_rank") - 1).cast("int")).drop(
        "chunk", "_f", "_rank", "_base"
    )


def first_clips(
    df: DataFrame, limit: int | None, source: str = "source", clip_column: str = "clip", slice_by: str = "image_id"
) -> DataFrame:
    """Rows of the first ``limit`` clips of each source in name order."""
    if limit is None:
        return df
    counted = df.groupBy(source, clip_column).agg(F.count("*").alias("_rows"))
    order = Window.partitionBy(source).orderBy(clip_column)
    kept = counted.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= limit)
    own = F.concat_ws("\u0001", source, clip_column)
    return attach_by_key(
        df.withColumn("_own", own), kept.select(own.alias("_own"), "_rows", "_k"), "_own", "_rows", [slice_by]
    ).drop("_own", "_k")


def group_annotations(
    images: DataFrame, annotations: DataFrame, max_persons: int = 2, limit: int | None = None
) -> DataFrame:
    """Annotations -> (source, clip, frame, person, score, joints).

    The last image of a repeated id counts; annotations without an image are dropped.
    Annotations are cut to the best ``max_persons`` per image before the join, which
    keeps the result and bounds what one image id can bring to it.
    """
    named = split_frame_path(
        images.groupBy("source", "id").agg(F.max_by("file_name", "pos").alias("file_name")), "file_name"
    ).select("source", F.col("id").alias("image_id"), "clip", "frame")
    scored = annotations.withColumn("score", F.coalesce("score", F.lit(1.0)))
    best = top_people(scored, ["source", "image_id"], max_persons).drop("person")
    placed = first_clips(best.join(named, ["source", "image_id"]), limit)
    people = top_people(placed, ["source", "clip", "frame"], max_persons)
    return dense_frames(
        people.withColumn("_clip", F.concat_ws("\u0001", "source", "clip")), "_clip"
    ).select(
        "source",
        "clip",
        "frame",
        "person",
        "score",
        visible_joints(first_joints(F.col("keypoints"))).alias("joints"),
    )


# --- dense axes --------------------------------------------------------------------------------


def zero_joints() -> Column:
    return F.array_repeat(
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("s")), NUM_JOINTS
    )


def densify(
    poses: DataFrame, clips: DataFrame, max_persons: int = 2, key: str = "clip_id"
) -> DataFrame:
    """Every (frame, slot) of every clip; absent people are all-zero skeletons.

    Slots at or above ``max_persons`` are cut, as the fixed-size clip format does.
    """
    spine = frame_spine(clips, key).withColumn(
        "person", F.explode(F.sequence(F.lit(0), F.lit(max_persons - 1)))
    )
    return spine.join(poses.select(key, "frame", "person", "joints"), [key, "frame", "person"], "left").withColumn(
        "joints", F.coalesce("joints", zero_joints())
    )
