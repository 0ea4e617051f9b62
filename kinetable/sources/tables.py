"""Parquet tables of the pose model: readers that tolerate a missing folder, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinetable.schemas import CLIPS, POSES
from kinetable.sources.files import path_exists


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or an empty one with the same schema when the folder does not exist."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, f"{path}/clips", CLIPS)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, f"{path}/poses", POSES)


def clip_key(path: str | None = None, column=None):
    """Clip id of a clip path: slashes become double underscores."""
    return F.replace(column if column is not None else F.col(path), F.lit("/"), F.lit("__"))


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` in order, typed; missing optional ones become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def write_clips(clips: DataFrame, poses: DataFrame, path: str, mode: str = "append") -> None:
    """Unified clips as two tables partitioned by dataset."""
    conform(clips, CLIPS).write.mode(mode).partitionBy("dataset").parquet(f"{path}/clips")
    conform(poses, POSES).write.mode(mode).partitionBy("dataset").parquet(f"{path}/poses")


def write_pixels(pixels: DataFrame, path: str, mode: str = "append") -> None:
    """Rendered sparse frames, partitioned by the folder of their segment."""
    pixels.write.mode(mode).partitionBy("folder").parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "append") -> None:
    """Timeline or incident rows."""
    df.write.mode(mode).parquet(path)
