"""NumPy array files: event segments, per-clip pose arrays, unified clip archives.

Arrays are read by :mod:`kinetable.sources.formats` where Arrow can open the store. Elsewhere, and
for archives, Spark spreads the files over tasks; each task decodes its files with NumPy and
hands rows on in bounded batches.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.dims import NUM_JOINTS
from kinetable.functions.text import parent, stem
from kinetable.operators.events import FIELD_ALIASES, field_names
from kinetable.schemas import ARRAY_POSES, CLIPS, POSES
from kinetable.sources import formats
from kinetable.sources.files import path_exists, qualified, read_binary, relative_id, short_path

BATCH_EVENTS = 200_000
BATCH_FRAMES = 2_000


def event_table(content: bytes, path: str) -> pd.DataFrame:
    """Columns t_us, x, y, p of one file.

    A plain array has them by place; a structured one has its fields as columns, which
    ``field_names`` chooses like those of any other table.
    """
    raw = np.load(io.BytesIO(content), allow_pickle=False)
    if raw.dtype.names:
        named = field_names(list(raw.dtype.names), f"{path}: ")
        return pd.DataFrame({field: raw[name].astype(float) for field, name in named.items()})
    if raw.ndim == 2 and raw.shape[1] == len(FIELD_ALIASES):
        return pd.DataFrame(raw.astype(float), columns=[out for out, _ in FIELD_ALIASES])
    raise ValueError(f"{path}: an event array has four columns, this one has the shape {raw.shape}")


def read_event_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Event segments below ``path`` -> (folder, segment, t_us, x, y, p).

    ``folder`` is relative to ``path`` and empty for files directly in it.
    """
    root = qualified(spark, path)
    rows = formats.load(spark, "event_arrays", path, "*.npy") if formats.reachable(path) else _whole_event_arrays(spark, path)
    inside = F.regexp_replace(parent(short_path(F.col("path"))), "^" + re.escape(root) + "/?", "")
    return rows.select(
        inside.alias("folder"), stem(F.col("path")).alias("segment"), "t_us", "x", "y", "p"
    )


def _whole_event_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The same from a store that only Spark can open: a file is a row of at most 2 GB."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                events = event_table(content, name)
                for at in range(0, len(events), BATCH_EVENTS):
                    yield events.iloc[at : at + BATCH_EVENTS].assign(path=name)[["path", "t_us", "x", "y", "p"]]

    return read_binary(spark, path, "*.npy").mapInPandas(decode, "path string, t_us double, x double, y double, p double")


def pose_array(content: bytes, path: str) -> np.ndarray:
    """(T, M, 51) keypoints of one file: the ``keypoints`` member, else the first one."""
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(loaded, np.lib.npyio.NpzFile):
        member = "keypoints" if "keypoints" in loaded.files else loaded.files[0]
        loaded = loaded[member]
    width = NUM_JOINTS * 3
    if loaded.ndim == 4 and loaded.shape[2:] == (NUM_JOINTS, 3):
        return loaded.reshape(*loaded.shape[:2], width)
    if loaded.ndim == 3 and loaded.shape[2] == width:
        return loaded
    raise ValueError(f"{path}: keypoints need shape (T, M, 17, 3) or (T, M, 51), found {loaded.shape}")


def _dense_rows(values: np.ndarray, frames: np.ndarray) -> pd.DataFrame:
    """Rows (frame, person, values) of a (T, M, width) block."""
    count, people, width = values.shape
    return pd.DataFrame(
        {
            "frame": np.repeat(frames, people).astype(np.int32),
            "person": np.tile(np.arange(people, dtype=np.int32), count),
            "keypoints": list(values.reshape(-1, width).astype(np.float64)),
        }
    )


def read_pose_arrays(spark: SparkSession, path: str, glob: str = "*.np[yz]") -> DataFrame:
    """Per-clip keypoint arrays -> (path, num_frames, frame, person, keypoints)."""
    return pose_rows(spark, path, glob).where(F.col("frame").isNotNull())


def pose_rows(spark: SparkSession, path: str, glob: str = "*.np[yz]") -> DataFrame:
    """The rows of ``read_pose_arrays`` and one row per file without a frame, so that clips
    without frames or people keep their length."""
    if formats.reachable(path):
        return formats.load(spark, "pose_arrays", path, glob, heads="true")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                values = pose_array(content, name)
                head = {"path": name, "num_frames": np.int32(len(values)), "frame": None, "person": None, "keypoints": None}
                yield pd.DataFrame([head]).astype({"frame": "Int32", "person": "Int32"})
                for at in range(0, len(values) if values.shape[1] else 0, BATCH_FRAMES):
                    block = values[at : at + BATCH_FRAMES]
                    part = _dense_rows(block, np.arange(at, at + len(block)))
                    part.insert(0, "path", name)
                    part.insert(1, "num_frames", np.int32(len(values)))
                    yield part

    return read_binary(spark, path, glob).mapInPandas(decode, ARRAY_POSES)


def read_clip_archives(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(clips, poses) of a folder of unified ``.npz`` archives; a missing folder gives empty tables."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], CLIPS), spark.createDataFrame([], POSES)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    row = {"path": name, "num_frames": len(data["scores"])}
                    for field in ("action", "label", "label_name", "aggressive"):
                        row[field] = data[field].item() if field in data.files else None
                    size = data["frame_size"] if "frame_size" in data.files else (None, None)
                    row["frame_w"], row["frame_h"] = size[0], size[1]
                    row["source"] = str(data["source"]) if "source" in data.files else name
                rows.append(row)
            yield pd.DataFrame(
                rows,
                columns=["path", "source", "num_frames", "action", "label", "label_name",
                         "aggressive", "frame_w", "frame_h"],
            )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    points, scores = data["keypoints"], data["scores"]
                values = np.concatenate([points, scores[..., None]], axis=-1)
                values = values.reshape(*values.shape[:2], NUM_JOINTS * 3)
                for at in range(0, len(values), BATCH_FRAMES):
                    block = values[at : at + BATCH_FRAMES]
                    part = _dense_rows(block, np.arange(at, at + len(block)))
                    part.insert(0, "path", name)
                    yield part

    files = read_binary(spark, path, "*.npz", require=False)
    meta = files.mapInPandas(
        describe,
        "path string, source string, num_frames int, action int, label int, label_name string,"
        " aggressive boolean, frame_w int, frame_h int",
    )
    clips = meta.select(
        F.lit(dataset).alias("dataset"), relative_id(spark, path, F.col("path")).alias("clip_id"),
        *[f.name for f in CLIPS.fields[2:]],
    )
    rows = files.mapInPandas(decode, "path string, frame int, person int, keypoints array<double>")
    poses = rows.select(
        F.lit(dataset).alias("dataset"),
        relative_id(spark, path, F.col("path")).alias("clip_id"),
        "frame",
        "person",
        F.expr(
            f"transform(sequence(0, {NUM_JOINTS - 1}), j -> struct("
            "cast(keypoints[3*j] AS float) AS x, cast(keypoints[3*j+1] AS float) AS y,"
            "cast(keypoints[3*j+2] AS float) AS s))"
        ).alias("joints"),
    )
    return clips, poses
