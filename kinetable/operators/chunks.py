"""Skew-safe building blocks for ordered operators on long streams.

One stream may hold a third of all rows, so no operator sorts a whole stream in
one task. A stream is cut into chunks of consecutive frames; rows near a border
are also sent to the neighbouring chunk (the halo), so a bounded window can be
evaluated inside (stream, chunk). Unbounded prefixes use one summary row per
chunk. Frames are 32-bit, so a stream has at most 2**31 / CHUNK = 524,288
summary rows: a proven bound for the single small window over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
HOT_KEYS = 1024
HOT_SLICES = 1024


def chunk_size(reach: int = 0) -> int:
    """Chunk length for a window reaching ``reach`` frames: the halo stays under an eighth."""
    return max(CHUNK, 8 * int(reach))


def with_chunk(df: DataFrame, frame: str = "frame") -> DataFrame:
    return df.withColumn("chunk", F.expr(f"cast({frame} as bigint) div {chunk_size()}"))


def with_halo(df: DataFrame, frame: str = "frame", back: int = 0, ahead: int = 0) -> DataFrame:
    """Add ``chunk`` and ``core``; border rows appear once more per chunk that needs them.

    A chunk sees ``back`` frames before its first and ``ahead`` frames after its last.
    ``core`` is true on the one copy that the chunk owns.
    """
    size = chunk_size(back + ahead)
    first = f"greatest(cast({frame} as bigint) - {int(ahead)}, 0L) div {size}"
    last = f"(cast({frame} as bigint) + {int(back)}) div {size}"
    spread = df.withColumn("chunk", F.expr(f"explode(sequence({first}, {last}))"))
    return spread.withColumn("core", F.expr(f"chunk = cast({frame} as bigint) div {size}"))


def earlier(key: str) -> object:
    """Window over the chunk summaries of a stream that lie before the current chunk."""
    return (
        Window.partitionBy(key)
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def attach_by_key(
    df: DataFrame, facts: DataFrame, key: str, weight: str, slice_by: list[str]
) -> DataFrame:
    """Inner join of one ``facts`` row per key onto ``df`` that never gathers a hot key.

    The HOT_KEYS heaviest keys (a fixed number of rows) are broadcast. Every other
    key holds at most 1/HOT_KEYS of the rows and goes through a normal join. Rows of the
    broadcast keys take a slice number, a hash of ``slice_by``, as their join key, so that
    they spread out and match nothing. (One text key, because an extra slice column equal
    to a constant would be optimized away and bring the hot key back together.)
    """
    names = [c for c in facts.columns if c not in (key, weight)]
    # Both branches read the same columns, so that they share one shuffle of the facts.
    packed = facts.select(
        F.concat(F.lit("k"), F.col(key).cast("string")).alias("_key"),
        F.col(weight).alias("_weight"),
        F.struct(*names, F.col(weight).alias("_w")).alias("_fact"),
    ).filter(F.col("_key").isNotNull())
    hot = (
        packed.orderBy(F.col("_weight").desc(), "_key")
        .limit(HOT_KEYS)
        .select(F.col("_key").alias("_hot_key"), F.col("_fact").alias("_hot"))
    )
    cold = packed.select(F.col("_key").alias("_cold_key"), "_fact")
    own_key = F.concat(F.lit("k"), F.col(key).cast("string"))
    slice_key = F.concat(
        F.lit("s"), F.pmod(F.xxhash64(*slice_by), F.lit(HOT_SLICES)).cast("string")
    )
    marked = df.join(F.broadcast(hot), own_key == F.col("_hot_key"), "left").withColumn(
        "_join", F.when(F.col("_hot_key").isNotNull(), slice_key).otherwise(own_key)
    )
    joined = marked.join(cold, F.col("_join") == F.col("_cold_key"), "left")
    fact = F.coalesce("_hot", "_fact")
    return joined.withColumn("_known", fact).filter(F.col("_known").isNotNull()).select(
        *df.columns, *[F.col("_known")[n].alias(n) for n in names]
    )


def number_rows(df: DataFrame, key: str, slot: Column, order: list[Column], name: str) -> DataFrame:
    """0-based position of each row within its key, without sorting a whole key in one task.

    ``slot`` is a coarse column that is monotone in ``order`` (an hour, a date); rows are
    ranked inside (key, slot) and shifted by the count of the earlier slots.
    """
    slotted = df.withColumn("chunk", slot)
    counts = slotted.groupBy(key, "chunk").agg(F.count("*").alias("_n"))
    base = counts.select(
        key, "chunk", F.coalesce(F.sum("_n").over(earlier(key)), F.lit(0)).alias("_base")
    )
    local = slotted.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(key, "chunk").orderBy(*order))
    )
    placed = local.join(base, [key, "chunk"])
    return placed.withColumn(name, (F.col("_base") + F.col("_rank") - 1).cast("int")).drop(
        "chunk", "_rank", "_base"
    )


def explode_span(
    df: DataFrame, start: str, end: str, key: str, name: str = "frame", parts: int = 1, piece: str | None = None
) -> DataFrame:
    """One row per frame of the half-open span.

    Spans are first cut into chunk pieces and the pieces dealt out over the shuffle
    partitions, at least ``parts``, so that one very long span does not expand in a single
    task. ``piece`` names a column that keeps the piece's number.
    """
    slots = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = chunk_size()
    pieces = df.filter(F.col(end) > F.col(start)).withColumn(
        "_piece",
        F.expr(
            f"explode(sequence(cast({start} as bigint) div {size},"
            f" (cast({end} as bigint) - 1) div {size}))"
        ),
    )
    return (
        pieces.repartition(slots, key, "_piece")
        .withColumn(
            name,
            F.expr(
                f"explode(sequence(cast(greatest({start}, _piece * {size}) as int),"
                f" cast(least({end}, (_piece + 1) * {size}) - 1 as int)))"
            ),
        )
        .withColumnsRenamed({"_piece": piece} if piece else {})
        .drop(*([] if piece else ["_piece"]))
    )


def frame_spine(clips: DataFrame, key: str = "clip_id", frames: str = "num_frames") -> DataFrame:
    """Every (key, frame) of the clips, empty frames included."""
    base = clips.select(key, F.lit(0).alias("_zero"), F.col(frames).alias("_frames"))
    return explode_span(base, "_zero", "_frames", key).select(key, "frame")
