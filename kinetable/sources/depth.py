"""Depth-camera text files (.skeleton)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.dims import NUM_DEPTH_JOINTS, depth_action_ids
from kinetable.functions.text import stem
from kinetable.session import materialize
from kinetable.sources import formats
from kinetable.sources.files import relative_id
from kinetable.sources.text import JOINT_FIELDS, skeleton_rows

NAME_PARTS = ["setup", "camera", "performer", "replication", "action"]
BATCH_BODIES = 2_000


def parse_clip_name(df: DataFrame, name: str) -> DataFrame:
    """SsssCcccPpppRrrrAaaa -> five integer columns."""
    return df.withColumns(
        {part: F.substring(name, 4 * i + 2, 3).try_cast("int") for i, part in enumerate(NAME_PARTS)}
    )


def _whole_texts(spark: SparkSession, path: str, classes: str) -> DataFrame:
    """The rows of ``depth_text`` from a store that only Spark can open: a file is one value."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.skeleton")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no .skeleton files under {path}")
    wanted = depth_action_ids(classes)
    if wanted is not None:
        action = F.regexp_extract("path", r"A(\d{3})[^/]*$", 1).try_cast("int")
        files = files.filter(action.isin(wanted))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["num_frames", "frame", "pos", "body_id", "values"]
        for batch in batches:
            for name, text in zip(batch["path"], batch["value"]):
                held = []
                for row in skeleton_rows(iter(text.split())):
                    held.append(row)
                    if len(held) == BATCH_BODIES:
                        yield pd.DataFrame(held, columns=columns).assign(path=name)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns).assign(path=name)

    return files.mapInPandas(
        decode,
        "num_frames int, frame int, pos int, body_id string, values array<double>, path string",
    )


def read_depth_skeletons(
    spark: SparkSession, path: str, classes: str = "all"
) -> tuple[DataFrame, DataFrame]:
    """(clips, bodies) of the .skeleton files below ``path``.

    ``classes`` filters on the action id in the file name, so that other files are not read.
    clips: path, clip_id, num_frames, setup .. action. bodies: path, clip_id, frame, pos,
    body_id, joints (25 structs of 12 numbers).
    """
    if formats.reachable(path):
        wanted = depth_action_ids(classes)
        names = "" if wanted is None else "A(" + "|".join(f"{int(i):03d}" for i in sorted(wanted)) + r")[^/]*$"
        rows = formats.load(spark, "depth_text", path, "*.skeleton", pathPattern=names)
        rows = rows.withColumn("clip_id", relative_id(spark, path, F.col("path")))
    else:
        rows = _whole_texts(spark, path, classes).withColumn("clip_id", relative_id(spark, path, F.col("path"), encoded=True))
    rows = materialize(rows, "depth-rows")
    heads = rows.filter(F.col("frame") < 0).select("path", "clip_id", "num_frames", stem(F.col("path")).alias("_name"))
    clips = parse_clip_name(heads, "_name").drop("_name")
    fields = ["x", "y", "z", "depth_x", "depth_y", "color_x", "color_y",
              "orient_w", "orient_x", "orient_y", "orient_z", "state"]
    picked = ", ".join(f"values[12*j+{i}] AS {f}" for i, f in enumerate(fields))
    joints = F.expr(f"transform(sequence(0, {NUM_DEPTH_JOINTS - 1}), j -> struct({picked}))")
    checked = F.when(
        F.size("values") == NUM_DEPTH_JOINTS * JOINT_FIELDS, joints
    ).otherwise(F.raise_error(F.concat(F.lit("unexpected joint count in "), F.col("path"))).cast(
        "array<struct<" + ",".join(f"{f}:double" for f in fields) + ">>"
    ))
    bodies = rows.filter(F.col("frame") >= 0).select(
        "path", "clip_id", "num_frames", "frame", "pos", "body_id", checked.alias("joints")
    )
    return clips, bodies
