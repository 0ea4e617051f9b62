"""Tables written as arrays, skeleton texts and archives, and read back by the sources."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.catalog.adapters import SENSOR_EVENTS, VECTOR_JOINTS, sensor_events, table, vector_poses
from kinetable.catalog.event_queries import CELLS, DAY_MS, SCALES, H, W
from kinetable.catalog.registry import query, r6, with_tables
from kinetable.functions.numeric import argmax, softmax
from kinetable.operators import events as ev
from kinetable.session import scratch_path
from kinetable.sources import formats
from kinetable.sources.arrays import read_clip_archives, read_event_arrays, read_pose_arrays
from kinetable.sources.depth import read_depth_skeletons
from kinetable.sources.files import find_sources, qualified, short_path
from kinetable.sources.tables import write_pixels


def _written(df: DataFrame, label: str, key: str, content: Callable[[str, pd.DataFrame], tuple[str, bytes]]) -> str:
    """A new folder with one file for each value of ``key``: its name and bytes from ``content``."""
    root = scratch_path(df.sparkSession, label)

    def put(rows: pd.DataFrame) -> pd.DataFrame:
        name, raw = content(rows[key].iloc[0], rows)
        system, place = formats.file_system(f"{root}/{name}")
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place) as out:
            out.write(raw)
        return pd.DataFrame({"name": [name]})

    df.groupBy(key).applyInPandas(put, "name string").count()
    return root


def _saved(save: Callable, *arrays, **named) -> bytes:
    out = io.BytesIO()
    save(out, *arrays, **named)
    return out.getvalue()


@query(
    "event_array_source",
    with_tables(SENSOR_EVENTS)
    + "SELECT 'part_' || (cast(segment AS bigint) % 2) AS folder, segment, t_us::DOUBLE AS t_us, x::DOUBLE AS x, y::DOUBLE AS y, p::DOUBLE AS p FROM sensor",
)
def event_array_source(spark, sf):
    """Plain arrays in one folder, structured ones under other field names in the other."""
    aliases = [("timestamp", "<i8"), ("x", "<f8"), ("y", "<f8"), ("polarity", "<f8")]

    def content(segment: str, rows: pd.DataFrame) -> tuple[str, bytes]:
        values = rows[["t_us", "x", "y", "p"]].to_numpy(float)
        if int(segment) % 2:
            values = np.array([tuple(v) for v in values], aliases)
        return f"part_{int(segment) % 2}/{segment}.npy", _saved(np.save, values)

    return read_event_arrays(spark, _written(sensor_events(spark, sf), "event-arrays", "segment", content))


POSE_SUMMARY = """ SELECT clip_id, frame, person, cast(count(*) AS int) AS joints, round(max(x), 6) AS x, round(min(y), 6) AS y, round(max(s), 6) AS s
    FROM pj GROUP BY ALL"""


#: Score of all joints of a person who is not in a frame of a dense array; scores of people are never negative.
ABSENT = -1.0


def _dense(rows: pd.DataFrame) -> np.ndarray:
    """(T, M, 51) keypoints of one clip; people who are not in a frame have the score ABSENT."""
    out = np.zeros((rows["frame"].max() + 1, rows["person"].max() + 1, 51))
    out[..., 2::3] = ABSENT
    out[rows["frame"], rows["person"]] = np.stack(rows["flat"].to_numpy())
    return out


def _flat_poses(spark, sf) -> DataFrame:
    flat = F.flatten(F.transform("joints", lambda j: F.array(j.x, j.y, j.s)))
    return vector_poses(spark, sf).select("clip_id", "frame", "person", flat.alias("flat"))


@query("pose_array_source", with_tables(VECTOR_JOINTS) + POSE_SUMMARY)
def pose_array_source(spark, sf):
    """Joint arrays as files, flattened ones as members of compressed archives."""

    def content(clip: str, rows: pd.DataFrame) -> tuple[str, bytes]:
        values = _dense(rows)
        if int(clip[-1]) % 2:
            return f"{clip}.npz", _saved(np.savez_compressed, first=np.zeros(1), keypoints=values)
        return f"{clip}.npy", _saved(np.save, values.reshape(*values.shape[:2], 17, 3))

    rows = read_pose_arrays(spark, _written(_flat_poses(spark, sf), "pose-arrays", "clip_id", content))
    rows = rows.where(F.col("keypoints")[2] != ABSENT)
    axis = {a: F.array(*[F.col("keypoints")[3 * j + i] for j in range(17)]) for i, a in enumerate("xys")}
    rows = rows.withColumn("clip_id", F.regexp_extract("path", r"([^/]*)[.]np[yz]$", 1)).withColumn("joints", (F.size("keypoints") / 3).cast("int"))
    rows = rows.withColumns({"x": F.array_max(axis["x"]), "y": F.array_min(axis["y"]), "s": F.array_max(axis["s"])})
    return rows.select("clip_id", "frame", "person", "joints", r6("x"), r6("y"), r6("s"))


@query(
    "clip_archive_source",
    with_tables(VECTOR_JOINTS)
    + """SELECT clip_id, frame, person, cast(right(clip_id, 1) AS int) % 2 AS label, cast(max(frame) OVER (PARTITION BY clip_id) + 1 AS int) AS num_frames,
           round(max(x)::FLOAT::DOUBLE, 6) AS x, round(max(s)::FLOAT::DOUBLE, 6) AS s FROM pj GROUP BY clip_id, frame, person""",
)
def clip_archive_source(spark, sf):
    """Unified clip archives -> clips and poses."""

    def content(clip: str, rows: pd.DataFrame) -> tuple[str, bytes]:
        values = _dense(rows)
        points = values.reshape(*values.shape[:2], 17, 3).astype(np.float32)
        named = {"keypoints": points[..., :2], "scores": points[..., 2], "label": int(clip[-1]) % 2}
        return f"{clip}.npz", _saved(np.savez_compressed, **named)

    clips, poses = read_clip_archives(spark, _written(_flat_poses(spark, sf), "clip-archives", "clip_id", content), "vectors")
    best = {a: F.array_max(f"joints.{a}").cast("double") for a in "xs"}
    poses = poses.where(F.col("joints")[0]["s"] != ABSENT)
    rows = poses.join(clips.select("dataset", "clip_id", "label", "num_frames"), ["dataset", "clip_id"]).withColumns(best)
    return rows.select("clip_id", "frame", "person", "label", "num_frames", r6("x"), r6("s"))


#: Number of a joint's value in a skeleton text.
_VALUE = "(({v} * 31 + {j} * 12 + {i}) % 1000) / 8.0"


@query(
    "depth_text_source",
    """WITH v AS (SELECT vec_id, vec_id // 20 AS clip, cast((vec_id % 20) // 2 AS int) AS frame, cast(vec_id % 2 AS int) AS pos FROM embeddings)
       SELECT 'S' || lpad((1 + clip // 1000)::VARCHAR, 3, '0') || 'C002P' || lpad((clip % 1000)::VARCHAR, 3, '0') || 'R001A' || lpad((48 + clip % 5)::VARCHAR, 3, '0') AS clip_id,
         cast(max(frame) OVER (PARTITION BY clip) + 1 AS int) AS num_frames, cast(clip % 1000 AS int) AS performer, cast(48 + clip % 5 AS int) AS action,
         frame, pos, (7000000000 + pos)::VARCHAR AS body_id, """
    + f"""{_VALUE.format(v="vec_id", j=0, i=0)} AS x, {_VALUE.format(v="vec_id", j=24, i=11)} AS state, {_VALUE.format(v="vec_id", j=8, i=5)} AS color_x FROM v""",
)
def depth_text_source(spark, sf):
    """Depth-camera texts, two bodies a frame."""
    rows = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 20").alias("clip"), F.expr("cast((vec_id % 20) div 2 AS int)").alias("frame"),
        F.expr("cast(vec_id % 2 AS int)").alias("pos"), "vec_id",
    )

    def content(clip: int, rows: pd.DataFrame) -> tuple[str, bytes]:
        lines = [str(rows["frame"].max() + 1)]
        for _, bodies in rows.sort_values("vec_id").groupby("frame"):
            lines.append(str(len(bodies)))
            for vec, pos in zip(bodies["vec_id"], bodies["pos"], strict=True):
                lines += [f"{7_000_000_000 + pos} " + "0 " * 9, "25"]
                lines += [" ".join(repr((vec * 31 + j * 12 + i) % 1000 / 8) for i in range(12)) for j in range(25)]
        return f"S{1 + clip // 1000:03d}C002P{clip % 1000:03d}R001A{48 + clip % 5:03d}.skeleton", "\n".join(lines).encode()

    clips, bodies = read_depth_skeletons(spark, _written(rows, "depth-texts", "clip", content))
    picked = {"x": F.col("joints")[0]["x"], "state": F.col("joints")[24]["state"], "color_x": F.col("joints")[8]["color_x"]}
    found = bodies.withColumns(picked).join(clips.select("clip_id", "performer", "action"), "clip_id")
    return found.select("clip_id", "num_frames", "performer", "action", "frame", "pos", "body_id", "x", "state", "color_x")


@query(
    "source_discovery",
    "SELECT DISTINCT 'u' || user_id AS source FROM events WHERE user_id % 3 = 0",
)
def source_discovery(spark, sf):
    """Child folders with images; folders with other files, and images deeper down, are no sources."""
    users = table(spark, sf, "events").select("user_id").distinct()

    def content(user: int, rows: pd.DataFrame) -> tuple[str, bytes]:
        return (f"u{user}/frame_0.JPG", f"u{user}/notes.txt", f"u{user}/deep/frame_0.png")[user % 3], b"x"

    root = _written(users, "sources", "user_id", content)
    inside = F.replace(short_path(F.col("source")), F.lit(qualified(spark, root) + "/"), F.lit(""))
    return find_sources(spark, root).select(inside.alias("source"))


@query(
    "pixel_sink_round_trip",
    with_tables(SENSOR_EVENTS, CELLS, SCALES)
    + """, lit AS (SELECT c.*, cast(trunc(least(n/scale*255.0, 255.0)) AS int) AS v FROM cells c JOIN scales USING (segment))
    SELECT 'part_' || (cast(segment AS bigint) % 2) AS folder, segment, frame, y, x, coalesce(max(v) FILTER (channel = 0), 0) AS r,
           coalesce(max(v) FILTER (channel = 1), 0) AS b FROM lit GROUP BY 1, 2, 3, 4, 5""",
)
def pixel_sink_round_trip(spark, sf):
    """Rendered frames in a folder per recording folder, read back."""
    pixels = ev.render(ev.accumulate(sensor_events(spark, sf), DAY_MS, H, W))
    folder = F.concat(F.lit("part_"), (F.col("segment").cast("long") % 2).cast("string"))
    pixels = pixels.select(folder.alias("folder"), "segment", "frame", "y", "x", "r", "b")
    path = scratch_path(spark, "pixels")
    write_pixels(pixels, path)
    return spark.read.schema(pixels.schema).parquet(path).select(pixels.columns)


@query(
    "softmax_argmax",
    """WITH l AS (SELECT vec_id, list_transform(embedding[1:5], lambda v: v::DOUBLE * 10) AS logits FROM embeddings),
       e AS (SELECT vec_id, logits, list_transform(logits, lambda v: exp(v - list_max(logits))) AS powers FROM l)
       SELECT vec_id, cast(list_position(logits, list_max(logits)) - 1 AS int) AS pred, round(list_max(powers) / list_sum(powers), 6) AS prob FROM e""",
)
def softmax_argmax(spark, sf):
    """Class and probability of five logits."""
    logits = F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double") * 10)
    rows = table(spark, sf, "embeddings").select("vec_id", softmax(logits).alias("probs"))
    return rows.withColumn("prob", F.array_max("probs")).select("vec_id", argmax(F.col("probs")).alias("pred"), r6("prob"))
