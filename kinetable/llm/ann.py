"""Nearest neighbours by multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.llm.common import store


#: Inner products that are held at a time.
SCORED = 4_000_000


class Settings(NamedTuple):
    """``hashes`` projections a table, cut to cells of ``width`` (in lengths of the longest
    vector); each query looks into ``probes`` buckets of each table. Buckets are spread over
    ``groups`` a table, and a group over tasks of about ``chunk`` vectors."""

    tables: int = 4
    hashes: int = 6
    width: float = 2.0
    probes: int = 160
    groups: int = 16
    chunk: int = 32768
    seed: int = 5


#: One cell, with those beside it, holds every vector: all are candidates of every query.
WHOLE = Settings(tables=1, hashes=1, width=1e6, probes=3)


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or zero, all components present and finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_classes(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: ``key``, ``vector`` and the ``keep`` smallest ids.

    Larger ids of equal vectors can be among no query's results, as ties go to smaller ids;
    the rank limits each task's rows before the shuffle, so a vector may be very frequent.
    """
    rank = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    first = rows.withColumn("_rank", rank).where(F.col("_rank") <= keep)
    return first.groupBy("key").agg(F.any_value("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _projections(dim: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([settings.seed, dim])
    directions = random.standard_normal((settings.tables, dim + 1, settings.hashes))
    return directions, random.uniform(0, settings.width, (settings.tables, settings.hashes))


def _cells(vectors: np.ndarray, longest: float, query: bool, settings: Settings) -> np.ndarray:
    """Place of each vector along each table's projections, in cells.

    Vectors are scaled by the longest and get one more component that lifts candidates to
    length 1 and is 0 in a query, so the nearest by distance have the largest inner product.
    """
    scaled = vectors / longest
    lift = np.zeros(len(scaled)) if query else np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
    directions, shifts = _projections(vectors.shape[1], settings)
    lifted = np.hstack([scaled, lift[:, None]])
    return (np.einsum("nd,tdh->nth", lifted, directions) + shifts) / settings.width


def _bucket(cells: np.ndarray) -> np.ndarray:
    """One number per row of whole cell numbers."""
    key = np.zeros(cells.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(cells.shape[-1]):
            key = (key ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def probes(cells: np.ndarray, count: int) -> np.ndarray:
    """Buckets of a query table by table, likeliest first.

    A perturbation moves some projections to the next cell up or down; its score is the sum of
    the squared distances to the borders crossed, the estimate of how unlikely a neighbour is
    there. All perturbations by one cell are scored and the ``count`` best are taken.
    """
    moves = np.array(list(product((0, -1, 1), repeat=cells.shape[-1])))
    base = np.floor(cells)
    up = 1.0 - (cells - base)
    down = cells - base
    cost = np.where(moves == 1, (up**2)[..., None, :], 0.0) + np.where(moves == -1, (down**2)[..., None, :], 0.0)
    order = np.argsort(cost.sum(axis=-1), axis=-1, kind="stable")[..., :count]
    return _bucket((base[..., None, :] + moves[order]).astype(np.int64))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors])


def _by_dim(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    yield from batch.groupby(batch["vector"].map(len))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest and everything about as large as the last of them."""
    if len(scores) <= k:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - k)[len(scores) - k]
    return np.flatnonzero(scores >= last - 1e-9 * max(1.0, abs(last)) if last > -np.inf else scores > -np.inf)


def search(classes: DataFrame, queries: DataFrame, k: int, settings: Settings | None = None) -> DataFrame:
    """(``query``, ``key``, ``ids``, ``score``): candidates of every query class, its best in each task.

    ``classes`` has one row per distinct vector and ``queries`` the keys of those that search.
    Every vector is in every table; all members of the buckets that a query visits are compared
    by inner product in double precision. A group of buckets is split by the vector's key into
    tasks of about ``settings.chunk`` vectors, so a full bucket is shared by many tasks.
    Vectors of different lengths never meet.
    """
    settings = settings or Settings()
    spark = classes.sparkSession
    dims = classes.groupBy(F.size("vector").alias("dim")).agg(
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("square")
    )
    # One row per vector length.
    longest = spark.sparkContext.broadcast({r["dim"]: float(np.sqrt(r["square"])) * (1 + 1e-12) for r in dims.collect()})

    def grouped(buckets: np.ndarray) -> np.ndarray:
        return (buckets.view(np.uint64) >> np.uint64(40)).astype(np.int64) % settings.groups

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                cells = _cells(_matrix(part["vector"]), longest.value[dim], False, settings)
                bucket = _bucket(np.floor(cells).astype(np.int64))
                for t in range(settings.tables):
                    yield part.assign(dim=dim, table=t, group=grouped(bucket[:, t]), bucket=bucket[:, t])

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                cells = _cells(_matrix(part["vector"]), longest.value[dim], True, settings)
                wanted = probes(cells, settings.probes)
                for t in range(settings.tables):
                    group = grouped(wanted[:, t])
                    for g in np.unique(group):
                        has = (group == g).any(axis=1)
                        yield part[has].assign(
                            dim=dim,
                            table=t,
                            group=g,
                            buckets=[w[h] for w, h in zip(wanted[has, t], group[has] == g, strict=True)],
                        )

    place = "dim int, table int, group long"
    members = classes.select("key", "vector", "ids").mapInPandas(
        placed, f"key string, vector array<double>, ids array<long>, {place}, bucket long"
    )
    asked = classes.join(queries.select("key").distinct(), "key", "left_semi").select("key", "vector")
    asked = asked.mapInPandas(probing, f"key string, vector array<double>, {place}, buckets array<long>")
    members = store(members, "members")
    # A row per group: tables * groups for each vector length.
    tasks = members.groupBy("dim", "table", "group").agg(F.ceil(F.count(F.lit(1)) / settings.chunk).alias("tasks"))
    at = ["dim", "table", "group"]
    members = members.join(F.broadcast(tasks), at).withColumn("task", F.pmod(F.xxhash64("key"), "tasks")).drop("tasks")
    spread = F.broadcast(tasks.select(*at, F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task")))
    asked = asked.join(spread, at)

    def compared(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "key", "ids", "score"]
        if not len(asks) or not len(held):
            return pd.DataFrame(columns=names)
        held = held.sort_values("bucket", kind="stable")
        mine, theirs = _matrix(asks["vector"]), _matrix(held["vector"])
        buckets, first, size = np.unique(held["bucket"].to_numpy(), return_index=True, return_counts=True)
        visits = asks["buckets"].map(lambda b: np.flatnonzero(np.isin(buckets, b)))
        keys, ids, asker, out = held["key"].to_numpy(), held["ids"].to_numpy(), asks["key"].to_numpy(), []
        lot = max(1, SCORED // len(held))
        for at in range(0, len(asks), lot):
            wanted = visits.iloc[at : at + lot].tolist()
            who, which = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted]), np.concatenate(wanted)
            scores = np.full((len(wanted), len(held)), -np.inf)
            for b in np.unique(which):
                rows_, columns = who[which == b], slice(first[b], first[b] + size[b])
                scores[rows_, columns] = mine[at + rows_] @ theirs[columns].T
            for q, line in enumerate(scores):
                found = _best(line, k)
                found = found[line[found] > -np.inf]
                # Summed row by row, so that equal vectors get equal scores.
                score = (theirs[found] * mine[at + q]).sum(axis=1)
                out.append(pd.DataFrame({"query": asker[at + q], "key": keys[found], "ids": ids[found], "score": score}))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    kind = "query string, key string, ids array<long>, score double"
    by = [*at, "task"]
    return asked.groupBy(*by).cogroup(members.groupBy(*by)).applyInPandas(compared, kind)


def _lists(found: DataFrame, k: int) -> DataFrame:
    """(``query``, ``_near``): the k best of each query class over all tasks, nearest first."""
    found = found.groupBy("query", "key").agg(F.any_value("ids").alias("ids"), F.max("score").alias("score"))
    each = found.select("query", "score", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    each = each.withColumn("_place", best).where(F.col("_place") <= k)
    return each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_place", "vec_id", "score"))).alias("_near"))


def nearest(rows: DataFrame, wanted: Column, k: int = 20, settings: Settings | None = None) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the k nearest found of each wanted row.

    Input: ``vec_id``, ``vector``. Nearest is the largest inner product, ties go to the smaller
    vec_id, a row is not its own neighbour. Unusable vectors and null ids take no part; a row
    repeated with its id counts once. A query whose buckets hold fewer than k candidates is
    compared with all vectors; only where the table has fewer there are fewer results.
    """
    rows = rows.where(usable("vector") & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.col("vector").cast("array<double>").alias("vector"), wanted.alias("_wanted"))
    rows = rows.withColumn("key", F.md5(F.col("vector").cast("string").cast("binary")))
    # The id of a row with its vector once; vectors travel with the distinct ones only.
    classes = store(vector_classes(rows.dropDuplicates(["vec_id", "key"]), k + 1), "vectors")
    queries = store(rows.where("_wanted").select("vec_id", "key").distinct(), "queries")
    lists = store(_lists(search(classes, queries, k + 1, settings), k + 1), "near-lists")
    # One row per vector length.
    there = classes.groupBy(F.size("vector").alias("dim")).agg(F.least(F.sum(F.size("ids")), F.lit(k + 1)).alias("_enough"))
    asked = classes.join(queries.select("key").distinct(), "key", "left_semi").select("key", F.size("vector").alias("dim"))
    met = asked.join(lists.select(F.col("query").alias("key"), F.size("_near").alias("_met")), "key", "left")
    short = met.join(F.broadcast(there), "dim").where(F.coalesce("_met", F.lit(0)) < F.col("_enough"))
    short = store(short.select("key"), "short-queries")
    if not short.isEmpty():
        more = _lists(search(classes, short, k + 1, WHOLE), k + 1)
        lists = lists.join(short.withColumnRenamed("key", "query"), "query", "left_anti").unionByName(more)
    joined = queries.join(lists, queries["key"] == lists["query"])
    others = F.slice(F.filter("_near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    flat = joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("_pos", "_one"))
    return flat.select("query_id", (F.col("_pos") + 1).alias("rank"), F.col("_one.vec_id").alias("vec_id"), F.col("_one.score").alias("score"))
