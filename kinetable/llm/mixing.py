"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.llm.common import WORD, numbered

#: Expected copies are whole multiples of 2**-FRACTION, so prefix sums are exact.
FRACTION = 20


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    """A text that tells a null source from any other."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def offset(key: Column, seed: str) -> Column:
    """The random offset of a source, in [0, 2**FRACTION)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, FRACTION // 4)
    return F.conv(digits, 16, 10).cast("long")


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds ``target`` to (``source_size``, ``weight``): a share of all sizes, split by weight.

    A target stops at ``cap`` times its source's size and the excess goes to the others by
    weight until none is above: sources in order of cap by weight fill up first, so the
    first one whose cap is above its part of the rest sets the level for all that follow.
    One row per source, the size of the mix's configuration.
    """
    limit = F.col("source_size") * F.lit(cap)
    ordered = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sources.withColumn("_limit", limit)
        .withColumn("_total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("_weights", F.sum("weight").over(whole))
        .withColumn("_level", level)
        .withColumn("_free", F.col("_limit") > F.col("_level") * F.col("weight"))
        .withColumn("_place", F.row_number().over(ordered))
        .withColumn("_set", F.min_by(F.when(F.col("_free"), F.col("_level")), F.when(F.col("_free"), F.col("_place"))).over(whole))
        .withColumn("target", F.when(F.col("_free"), F.col("_set") * F.col("weight")).otherwise(F.col("_limit")))
        .drop("_limit", "_total", "_weights", "_level", "_free", "_place", "_set")
    )


def cycled_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Weights dealt to the sources by code point, null last, over and over."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int")))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    rows: int | None = None,
) -> DataFrame:
    """Decides how often each document enters the mix.

    Input: ``doc_id``, ``source`` and a long ``size``; other columns are kept, those named like
    a result are replaced. Adds ``source_size``, ``target`` and ``copies``. Within a source the
    documents stand in order of size, so the words taken come near the target too; their
    expected copies are summed up from a random offset and a document is emitted once for each
    whole number its step crosses. A document without words takes part like any other, a null
    source is a source, repeated rows each count, an empty table gives an empty one. ``rows`` is
    that of :func:`kinetable.llm.common.store`.
    """
    docs = docs.drop("source_size", "target", "copies", "weight").withColumn("size", F.coalesce("size", F.lit(0)))
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc()]
    rows = numbered(docs, order, "mix", "_mix_row", rows)
    # At most a row per source.
    sources = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.min("_mix_row").alias("_first"), F.count(F.lit(1)).alias("_docs")
    )
    sources = targets(cycled_weights(sources, weights), share, cap)
    step = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * (1 << FRACTION)))
    sources = sources.select(
        source_key().alias("_source"),
        "source_size",
        "target",
        "_first",
        F.coalesce(step, F.lit(0)).cast("long").alias("_step"),
        offset(source_key(), seed).alias("_offset"),
    )
    place = F.col("_mix_row") - F.col("_first")
    crossed = [F.shiftright(F.col("_step") * (place + k) + F.col("_offset"), FRACTION) for k in (0, 1)]
    return (
        rows.withColumn("_source", source_key())
        .join(sources, "_source")
        .withColumn("copies", crossed[1] - crossed[0])
        .drop("_source", "_first", "_step", "_offset", "_mix_row")
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it was drawn."""
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return mixed.where(F.col("copies") > 0).withColumn("_copy", each).drop("_copy")
