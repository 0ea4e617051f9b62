"""Path checks, file listing and source discovery."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.dims import IMAGE_SUFFIXES, VIDEO_SUFFIXES
from kinetable.functions.text import parent, suffix


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    system, location = _file_system(spark, path)
    return system.exists(location)


def is_file(spark: SparkSession, path: str) -> bool:
    system, location = _file_system(spark, path)
    return system.exists(location) and system.getFileStatus(location).isFile()


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob pattern names at least one path."""
    system, location = _file_system(spark, pattern)
    return len(system.globStatus(location)) > 0


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as Spark writes it in file-path columns, without a trailing slash."""
    system, location = _file_system(spark, path)
    root = system.getFileStatus(location).getPath().toString().rstrip("/")
    return re.sub("^file:/+", "file:/", root)


def short_path(path: Column) -> Column:
    """File paths with one spelling of the local scheme."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def relative_id(spark: SparkSession, path: str, files: Column, encoded: bool = False) -> Column:
    """Clip id of a file: its path below ``path`` without suffix, slashes as double underscores.

    Equal names in two folders stay apart. ``encoded`` says that the column holds URIs, as
    ``_metadata.file_path`` does.
    """
    root = qualified(spark, path)
    if encoded:
        system, location = _file_system(spark, path)
        uri = system.getFileStatus(location).getPath().toUri().toASCIIString()
        root = re.sub("^file:/+", "file:/", uri.rstrip("/"))
    inside = F.regexp_replace(short_path(files), "^" + re.escape(root) + "/?", "")
    named = F.when(inside == "", F.regexp_extract(files, "([^/]*)$", 1)).otherwise(inside)
    return F.replace(F.regexp_replace(named, r"(?<=[^/])\.[^./]*$", ""), F.lit("/"), F.lit("__"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` with their suffix; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", suffix(F.col("path")).alias("suffix"))
    )


def read_binary(spark: SparkSession, path: str, glob: str, require: bool = True) -> DataFrame:
    """(path, content) of matching files. A file is one row, so it is limited to 2 GB by Spark."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    if require and files.select("path").isEmpty():
        raise FileNotFoundError(f"no {glob} files under {path}")
    return files.select("path", "content")


def find_sources(spark: SparkSession, path: str) -> DataFrame:
    """Clip sources below ``path``, one column ``source``, sorted.

    A single file is its own source; otherwise all videos in the tree; otherwise the
    folder itself when it holds images; otherwise its child folders that hold images.
    """
    if is_file(spark, path):
        return list_files(spark, path).select(F.col("path").alias("source"))
    files = list_files(spark, path)
    videos = files.filter(F.col("suffix").isin(VIDEO_SUFFIXES))
    if not videos.isEmpty():
        return videos.select(F.col("path").alias("source")).orderBy("source")
    here = F.lit(qualified(spark, path))
    folders = (
        files.filter(F.col("suffix").isin(IMAGE_SUFFIXES))
        .select(parent(short_path(F.col("path"))).alias("source"))
        .distinct()
    )
    own = folders.filter(F.col("source") == here)
    if not own.isEmpty():
        return own
    return folders.filter(parent(F.col("source")) == here).orderBy("source")
