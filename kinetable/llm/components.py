"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import store
from kinetable.session import discard


def _lower(links: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself, at one row per node."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    return both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u")).toDF("u", "v")
    return both.where("v > u").join(_lower(links), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(``node``, ``root``) for every node with a link; the root is the smallest node reachable.

    ``links`` has two long columns ``u`` and ``v``; ``rows`` is about their number, if known. Rounds grow with the logarithm of the
    longest chain. Each round's links are stored and those before are deleted; the driver sees a
    count and a sum of hashes.
    """
    links = store(links.toDF("u", "v").where("u <> v").distinct(), "links", rows)
    last, rows = None, links.count()
    while True:
        before, links = links, store(_small_star(_large_star(links)).distinct(), "links", rows)
        discard(before)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last, rows = now, now[0]
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(links.select("v", "v").distinct())
