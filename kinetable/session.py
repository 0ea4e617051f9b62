"""Session helpers: local test session, shared scratch folder, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinetable")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # The tables of a test are far below the default minimum of a shuffle partition.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: The temporary root of a local session, removed when the process ends.
_LOCAL_ROOTS: dict[str, tempfile.TemporaryDirectory] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or set on the context.

    Where neither is set, a local session gets a temporary folder; a cluster raises an error,
    because its executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local(\[.*\])?$", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = _LOCAL_ROOTS.setdefault(context.applicationId, tempfile.TemporaryDirectory(prefix="kinetable-"))
    context.setCheckpointDir(root.name)
    return root.name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the checkpoint folder."""
    return f"{_own_root(spark)}/{label}-{uuid.uuid4().hex}"


def _own_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/kinetable/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete what this application stored in the shared folder; results read from it end too."""
    _delete(spark, _own_root(spark))


#: Spark removes the shuffle files of an execution when it ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions inside leave no shuffle files behind: what they write is read from the table."""
    before = spark.conf.get(_CLEANUP, None)
    if before is None:  # an older Spark
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str, *partition_by: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors, cuts lineage.

    Its shuffle files go as soon as the table is written. ``rows_a_file`` is for rows so large that
    a task should not hold all it writes or reads.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    if rows_a_file:
        writer = writer.option("maxRecordsPerFile", rows_a_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _own_shuffles(df.sparkSession):
        writer.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[stored] = path
    return stored


#: Where the tables of :func:`materialize` lie, for :func:`discard`.
_STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, _STORED.pop(table))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
