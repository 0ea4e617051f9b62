"""Deterministic splits with exact sizes and no global sort.

The order is a seeded hash of the id. Ids are bucketed by hash prefix; the running
count over the 65,536 buckets gives each bucket its offset, and ids are ranked
inside their bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 4  # hex digits of the bucket: 16**4 buckets


def shuffled_rank(items: DataFrame, item: str, seed: int) -> DataFrame:
    """Add ``rank`` (0-based position in the seeded order) and ``total``."""
    digest = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(item).cast("string")))
    hashed = items.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, PREFIX))
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # At most 16**PREFIX rows: small enough for one window and for a broadcast.
    ordered = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", item)
    return (
        hashed.withColumn("_local", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("rank", F.col("_base") + F.col("_local") - 1)
        .drop("_digest", "_bucket", "_local", "_base")
    )


def assign_split(
    items: DataFrame,
    item: str = "clip_id",
    seed: int = 42,
    val_frac: float = 0.15,
    test_frac: float = 0.15,
) -> DataFrame:
    """First int(n * test_frac) items are test, the next int(n * val_frac) val, the rest train."""
    ranked = shuffled_rank(items, item, seed)
    n_test = F.floor(F.col("total") * F.lit(test_frac))
    n_val = F.floor(F.col("total") * F.lit(val_frac))
    split = (
        F.when(F.col("rank") < n_test, "test")
        .when(F.col("rank") < n_test + n_val, "val")
        .otherwise("train")
    )
    return ranked.withColumn("split", split).drop("rank", "total")


def assign_holdout(items: DataFrame, item: str = "clip_id", seed: int = 42, frac: float = 0.2) -> DataFrame:
    """Two-way split: val holds max(1, int(frac * n)) items; empty when there are fewer than two."""
    ranked = shuffled_rank(items, item, seed).filter(F.col("total") >= 2)
    n_val = F.greatest(F.floor(F.col("total") * F.lit(frac)), F.lit(1))
    return ranked.withColumn(
        "split", F.when(F.col("rank") < n_val, "val").otherwise("train")
    ).drop("rank", "total")


def select_split(items: DataFrame, split: str = "test") -> DataFrame:
    """Rows of one split; ``all`` keeps everything."""
    return items if split == "all" else items.filter(F.col("split") == split)
