"""Running a stream to the end of its input and reading back what it wrote."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from kinetable.session import scratch_path
from kinetable.streaming.ordered import CLOCK, timeless


def read_stream(
    spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet", files: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream, ``files`` per micro-batch, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def frame_clock(df: DataFrame, frame: str = "frame", out: str = "ts") -> DataFrame:
    """Event time that advances one second per frame."""
    return df.withColumn(out, F.timestamp_seconds(F.col(frame)))


#: Event time of the row that ends a stream; pandas has to hold it in nanoseconds.
END = "2200-01-01"


def ending(stream: DataFrame, label: str, clock: str = "ts") -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a second source beside it, and what writes the row that ends it there.

    That row has only an event time, far behind all others: it moves the watermark past every
    open window, so that they are emitted, and its own group is never closed.
    """
    spark, folder = stream.sparkSession, scratch_path(stream.sparkSession, f"{label}-end")
    schema = stream.schema
    spark.createDataFrame([], schema).write.parquet(folder)

    def end() -> None:
        columns = [F.lit(END if f.name == clock else None).cast(f.dataType).alias(f.name) for f in schema]
        spark.range(1).select(*columns).write.mode("append").parquet(folder)

    return stream.unionByName(read_stream(spark, folder, schema)), end


def closing(stream: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """:func:`ending` for the scans of :mod:`kinetable.streaming.ordered`, whose keys keep their own time."""
    return ending(timeless(stream), label, CLOCK)


#: Scans keep list state and timers, which need this store.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(stream: DataFrame, label: str, path: str | None = None) -> tuple[StreamingQuery, str]:
    """Append the stream to Parquet under the shared scratch folder, reading all present input.

    With the ``path`` of an earlier start the stream goes on where that one stopped. Rows that a
    scan marks as ``late`` go to a table of their own beside it (:func:`late_table`). A micro-batch
    that runs again replaces what it wrote before.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if "late" not in stream.columns:
        return writer.format("parquet").start(path), path

    def both(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("_late", F.col("late")).drop("late")
        # Read again from the table: the scan runs once a micro-batch.
        rows.write.mode("overwrite").partitionBy("_late").parquet(f"{path}/batch={number}")

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return writer.foreachBatch(both).start(), path
    finally:
        spark.conf.set(_STORE, before)


def _written(stream: DataFrame, path: str, late: bool) -> DataFrame:
    columns = [f for f in stream.schema if f.name != "late"]
    places = [StructField("batch", IntegerType()), StructField("_late", BooleanType())]
    found = stream.sparkSession.read.schema(StructType([*columns, *places])).option("basePath", path)
    return found.parquet(path).filter(F.col("_late") == late).drop("batch", "_late")


def drain(stream: DataFrame, label: str, end: Callable[[], None] | None = None) -> DataFrame:
    """Run to the end of the present input, then past ``end`` if given; the rows written, late ones left out."""
    return drain_both(stream, label, end)[0]


def drain_both(stream: DataFrame, label: str, end: Callable[[], None] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Like :func:`drain`, with the table of the late rows of a scan."""
    query, path = start(stream, label)
    query.awaitTermination()
    # The first batch with an end moves the watermark, the second one works under it.
    for _ in range(2 if end is not None else 0):
        end()
        start(stream, label, path)[0].awaitTermination()
    if "late" in stream.columns:
        return _written(stream, path, False), _written(stream, path, True)
    return stream.sparkSession.read.schema(stream.schema).parquet(path), None


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop behind the watermark, from every progress they report.

    Attach it before the query starts: ``with LateRows(spark) as late: ...; late.of(query)``.
    """

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark, self.dropped, self.ended = spark, Counter(), defaultdict(Event)

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.dropped[str(progress.runId)] += sum(int(o.numRowsDroppedByWatermark) for o in progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def of(self, query: StreamingQuery) -> int:
        """Rows that the query dropped by the time it ends; waits for its last report."""
        query.awaitTermination()
        self.ended[str(query.runId)].wait()
        return self.dropped[str(query.runId)]
