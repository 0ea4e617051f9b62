"""Helpers shared by the operators: table access, stored tables, global row numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetable.session import materialize

#: ``monotonically_increasing_id`` holds the row's place in its partition in this many low bits.
PLACE_BITS = 33
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lets whole texts reach Python in batches of about 1 MB, unless the session sets a size.

    Buffers of the default of 64 MB, on either side of the pipe and in every thread that has
    written one, are more than a small executor has beside its heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "1m")


def segments(text: str | bytes, size: int, gap: re.Pattern) -> Iterator[str | bytes]:
    """The whole text in pieces of about ``size``, each cut after a match of ``gap``: no word is torn."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = gap.search(text, end)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end


#: Narrow rows that a stored file holds at least, where their number is known.
ROWS_A_FILE = 1 << 15


def store(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors.

    With about how many ``rows`` it has, a small table is a few files instead of one a partition.
    """
    return materialize(df if rows is None else df.coalesce(rows // ROWS_A_FILE + 1), f"llm-{label}")


def id_crc(column: str = "doc_id") -> Column:
    """CRC-32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))


def numbered(df: DataFrame, order: list[Column], label: str, name: str = "row_no", rows: int | None = None) -> DataFrame:
    """All rows stored in the given total order, with a gapless global number from 0.

    Rows are range-partitioned, so no key, however frequent, has to fit one task as long as
    ``order`` tells its rows apart; rows that tie are told apart by where they were read, so
    ``df`` should read a table without a shuffle in between. Only one count per partition is
    gathered. The numbers do not depend on the partition bounds; ties are exchangeable. ``rows``
    is that of :func:`store`: places are marked before partitions share a file.
    """
    mark, read = f"_{name}_place", f"_{name}_read"
    keys = [*order, F.col(read)]
    placed = df.withColumn(read, F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(read)
    placed = store(placed.withColumn(mark, F.monotonically_increasing_id()), label, rows)
    part = F.shiftright(mark, PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: their number is a setting, not a function of the rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_part").alias("_in_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    place = F.col(mark).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (
        placed.join(F.broadcast(starts), part == F.col("_in_part"))
        .withColumn(name, F.col("_start") + place)
        .drop(mark, "_in_part", "_start")
    )
