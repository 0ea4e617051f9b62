"""Explicit schemas of the pose model; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

JOINT = T.StructType(
    [
        T.StructField("x", T.FloatType()),
        T.StructField("y", T.FloatType()),
        T.StructField("s", T.FloatType()),
    ]
)

# One row per (clip, frame, person); joints always has 17 entries in COCO order.
POSES = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("clip_id", T.StringType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("person", T.IntegerType()),
        T.StructField("joints", T.ArrayType(JOINT)),
    ]
)

# One row per clip. num_frames keeps frames in which nobody is visible.
CLIPS = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("clip_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("num_frames", T.IntegerType()),
        T.StructField("action", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_name", T.StringType()),
        T.StructField("aggressive", T.BooleanType()),
        T.StructField("frame_w", T.IntegerType()),
        T.StructField("frame_h", T.IntegerType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("segment", T.StringType()),
        T.StructField("t_us", T.DoubleType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("p", T.DoubleType()),
    ]
)

# Twelve numbers per tracked depth-camera joint, in file order.
DEPTH_JOINT = T.StructType(
    [
        T.StructField(name, T.DoubleType())
        for name in (
            "x", "y", "z", "depth_x", "depth_y", "color_x", "color_y",
            "orient_w", "orient_x", "orient_y", "orient_z", "state",
        )
    ]
)

BODIES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("num_frames", T.IntegerType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("body_id", T.StringType()),
        T.StructField("joints", T.ArrayType(DEPTH_JOINT)),
    ]
)

KEYPOINT_IMAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_name", T.StringType()),
    ]
)

KEYPOINT_ANNOTATION = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("keypoints", T.ArrayType(T.DoubleType())),
        T.StructField("score", T.DoubleType()),
    ]
)

KEYPOINT_DOCUMENT = T.StructType(
    [
        T.StructField("images", T.ArrayType(KEYPOINT_IMAGE)),
        T.StructField("annotations", T.ArrayType(KEYPOINT_ANNOTATION)),
    ]
)

# Per-clip arrays flattened to one row per (clip, frame, person): 17 x (x, y, v).
ARRAY_POSES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("num_frames", T.IntegerType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("person", T.IntegerType()),
        T.StructField("keypoints", T.ArrayType(T.DoubleType())),
    ]
)

DETECTIONS = T.StructType(
    [
        T.StructField("clip_id", T.StringType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("det", T.IntegerType()),
        T.StructField("box_conf", T.DoubleType()),
        T.StructField("joints", T.ArrayType(JOINT)),
    ]
)
