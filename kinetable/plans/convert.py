"""Raw recordings -> unified clip tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.dims import COLOR_FRAME
from kinetable.operators.chunks import attach_by_key
from kinetable.operators.events import accumulate, render
from kinetable.operators.ingest import (
    bodies_to_poses,
    densify,
    first_joints,
    group_annotations,
    visible_joints,
)
from kinetable.operators.labels import attach_depth_labels, event_label_columns
from kinetable.session import materialize
from kinetable.sources.arrays import pose_rows, read_event_arrays
from kinetable.sources.depth import read_depth_skeletons
from kinetable.sources.files import is_file, matches, relative_id
from kinetable.sources.keypoints import read_keypoint_json
from kinetable.sources.tables import clip_key


def convert_depth(
    spark: SparkSession,
    path: str,
    dataset: str,
    classes: str = "relevant",
    max_bodies: int = 2,
    mode: str = "color",
    subtle_as_aggressive: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Depth-camera text files -> (clips, poses)."""
    found, bodies = read_depth_skeletons(spark, path, classes)
    labelled = attach_depth_labels(found, subtle_as_aggressive=subtle_as_aggressive)
    clips = labelled.select(
        F.lit(dataset).alias("dataset"), "clip_id", F.col("path").alias("source"), "num_frames",
        "action", "label", "label_name", "aggressive",
        F.lit(COLOR_FRAME[0]).alias("frame_w"), F.lit(COLOR_FRAME[1]).alias("frame_h"),
    )
    poses = densify(bodies_to_poses(bodies, max_bodies, mode), clips, max_bodies)
    return clips, poses.withColumn("dataset", F.lit(dataset))


def convert_keypoints(
    spark: SparkSession,
    path: str,
    dataset: str,
    max_persons: int = 2,
    limit: int | None = None,
    layout: str = "flat",
) -> tuple[DataFrame, DataFrame]:
    """Keypoint JSON documents -> (clips, poses). ``limit`` caps the clips taken per document."""
    images, annotations = read_keypoint_json(spark, path, layout)
    people = group_annotations(images, annotations, max_persons, limit).withColumn(
        "clip_id", clip_key("clip")
    )
    people = materialize(people, "keypoint-people")
    # A clip that several documents name is that of the last one by path.
    last = people.groupBy("clip_id").agg(F.max("source").alias("_last"), F.count("*").alias("_rows"))
    people = attach_by_key(people, last, "clip_id", "_rows", ["frame"]).where(F.col("source") == F.col("_last")).drop("_last")
    counted = people.groupBy("clip_id", F.col("clip").alias("source")).agg(
        (F.max("frame") + 1).alias("num_frames")
    )
    clips = event_label_columns(counted, "source").withColumn("dataset", F.lit(dataset))
    poses = densify(people, clips, max_persons)
    return clips, poses.withColumn("dataset", F.lit(dataset))


def convert_arrays(
    spark: SparkSession, path: str, dataset: str, max_persons: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Per-clip keypoint arrays -> (clips, poses); the first ``max_persons`` slots are kept."""
    rows = pose_rows(spark, path).withColumn("clip_id", relative_id(spark, path, F.col("path")))
    rows = materialize(rows, "pose-arrays")
    counted = rows.groupBy("clip_id", F.col("path").alias("source")).agg(
        F.max("num_frames").alias("num_frames")
    )
    clips = event_label_columns(counted, "source").withColumn("dataset", F.lit(dataset))
    joints = visible_joints(first_joints(F.col("keypoints")))
    poses = densify(
        rows.filter(F.col("frame").isNotNull() & (F.col("person") < max_persons)).select("clip_id", "frame", "person", joints.alias("joints")),
        clips, max_persons,
    )
    return clips, poses.withColumn("dataset", F.lit(dataset))


def convert_poses(
    spark: SparkSession, path: str, dataset: str, max_persons: int = 2, limit: int | None = None, layout: str = "flat"
) -> tuple[DataFrame, DataFrame]:
    """Keypoint documents directly in ``path`` (or the one named) if any, else pose arrays below it."""
    if is_file(spark, path):
        documents = path if path.endswith(".json") else None
    else:
        pattern = f"{path}/*keypoints*.json"
        documents = pattern if matches(spark, pattern) else None
    if documents:
        return convert_keypoints(spark, documents, dataset, max_persons, limit, layout)
    return convert_arrays(spark, path, dataset, max_persons)


def convert_events(spark: SparkSession, path: str, window_ms: float = 33.0) -> DataFrame:
    """Event segments -> sparse rendered pixels with the folder of each segment."""
    events = read_event_arrays(spark, path).withColumn(
        "recording", F.concat("folder", F.lit("/"), "segment")
    )
    pixels = render(accumulate(events, window_ms, key="recording"), key="recording")
    name = F.regexp_extract("recording", r"([^/]*)$", 1)
    folder = F.regexp_replace("recording", r"/[^/]*$", "")
    return pixels.select(folder.alias("folder"), name.alias("segment"), "frame", "y", "x", "r", "b")
