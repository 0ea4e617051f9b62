"""SimHash near-duplicates by a Gray-ordered hierarchical index over the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from kinetable.llm.common import numbered, small_batches, store
from kinetable.llm.components import components

#: Fingerprints in a leaf of the index, children of an upper node, fingerprints in a leaf's part.
LEAF, FANOUT, PART = 1024, 32, 32
SHINGLE, HASH_SEED, RADIUS = 3, 42, 2
#: Hashes whose bits are unpacked at a time.
CHUNK = 1 << 16


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed number; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < size:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        count = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
        count = len(words) - size + 1
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(HASH_SEED)), "<u8", count))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the SimHash of whole texts over shingles of three words, ASCII letters lower-cased."""
    small_batches(docs.sparkSession)
    return docs.withColumn(name, _fingerprints(F.col(text)))


def gray_rank(fingerprint: Column) -> Column:
    """Place of a fingerprint in Gray order, shifted so that signed comparison sorts it."""
    rank = fingerprint
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _apart(a: str, b: str) -> Column:
    """Bits that all fingerprints below one node have set and all below the other have not."""
    return F.bit_count(
        F.col(f"{a}_all").bitwiseAND(F.bitwise_not(F.col(f"{b}_any")))
    ) + F.bit_count(F.col(f"{b}_all").bitwiseAND(F.bitwise_not(F.col(f"{a}_any"))))


def index(fingerprints: DataFrame, rows: int | None = None) -> list[DataFrame]:
    """Levels of the index over distinct fingerprints (column ``fp``), leaves first.

    Leaves are runs of the Gray order, so neighbours share long bit patterns. A node keeps the
    bits that all below it have set (``all``) and the bits that any has (``any``): where both
    agree the pattern is shared. Leaves also hold their fingerprints. ``rows`` is about the number
    of fingerprints, if known.
    """
    ranked = numbered(fingerprints.select("fp", gray_rank(F.col("fp")).alias("_gray")), [F.col("_gray").asc()], "gray", rows=rows)
    leaves = ranked.withColumn("node", F.expr(f"row_no div {LEAF}")).groupBy("node").agg(
        F.expr("bit_and(fp)").alias("all"), F.expr("bit_or(fp)").alias("any"), F.sort_array(F.collect_list("fp")).alias("fps")
    )
    leaves = store(leaves.withColumn("parent", F.expr(f"node div {FANOUT}")), "leaves", rows)
    levels, count = [leaves], leaves.count()
    while count > 1:
        level = levels[-1].groupBy(F.col("parent").alias("node")).agg(
            F.expr("bit_and(all)").alias("all"), F.expr("bit_or(any)").alias("any")
        )
        levels.append(level.withColumn("parent", F.expr(f"node div {FANOUT}")))
        count = -(-count // FANOUT)
    return levels


def leaf_pairs(levels: list[DataFrame], radius: int = RADIUS) -> DataFrame:
    """Pairs (a <= b) of leaves that may hold links, found from the root down.

    A pair of nodes is opened only while the differences of their shared patterns do not
    exceed the radius, so whole groups drop out at once.
    """
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        one, two = (
            level.select(F.col("parent").alias(x), F.col("node").alias(f"{x}_node"), F.col("all").alias(f"{x}_all"), F.col("any").alias(f"{x}_any"))
            for x in ("a", "b")
        )
        near = (F.col("a_node") <= F.col("b_node")) & (_apart("a", "b") <= radius)
        pairs = pairs.join(one, "a").join(two, "b").where(near).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return pairs


def _parts(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in rows of PART in Gray order, with each row's shared bit pattern."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    order = np.argsort(rank, kind="stable")
    order = np.concatenate([order, np.repeat(order[-1:], -len(order) % PART)]).reshape(-1, PART)
    rows = fps[order]
    return order, np.bitwise_and.reduce(rows, axis=1), np.bitwise_or.reduce(rows, axis=1)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of fingerprints at most ``radius`` bits apart."""
    (ia, all_a, any_a), (ib, all_b, any_b) = _parts(a), _parts(b)
    apart = np.bitwise_count(all_a[:, None] & ~any_b[None, :]) + np.bitwise_count(all_b[None, :] & ~any_a[:, None])
    pa, pb = np.nonzero(apart <= radius)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(pa), 256):
        ra, rb = ia[pa[at : at + 256]], ib[pb[at : at + 256]]
        k, i, j = np.nonzero(np.bitwise_count(a[ra][:, :, None] ^ b[rb][:, None, :]) <= radius)
        found.append((ra[k, i], rb[k, j]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def spanning(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``count`` nodes reaches over the links."""
    label = np.arange(count)
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def links(levels: list[DataFrame], radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between different fingerprints at most ``radius`` bits apart.

    Of the links inside a pair of leaves a spanning forest is returned: every connection
    stays, and no group gives rows by the square of its size.
    """
    leaves = levels[0]
    one, two = (leaves.select(F.col("node").alias(x), F.col("fps").alias(f"{x}_fps")) for x in ("a", "b"))
    pairs = leaf_pairs(levels, radius).join(one, "a").join(two, "b").select("a", "b", "a_fps", "b_fps")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, x, y in batch.itertuples(index=False):
                x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
                i, j = near_pairs(x.view(np.uint64), y.view(np.uint64), radius)
                if a == b:
                    nodes = x
                else:
                    nodes, j = np.concatenate([x, y]), j + len(x)
                keep = i != j
                label = spanning(len(nodes), i[keep], j[keep])
                moved = np.flatnonzero(label != np.arange(len(nodes)))
                if len(moved):
                    yield pd.DataFrame({"u": nodes[moved], "v": nodes[label[moved]]})

    return pairs.repartition("a", "b").mapInPandas(compare, "u long, v long")


def near_duplicates(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(``fp``, ``root``) for each distinct fingerprint of ``prints`` that has a link."""
    distinct = store(prints.select("fp").distinct(), "fingerprints")
    return components(links(index(distinct), radius))


def near_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds ``component_id`` to (``doc_id``, ``fp``): the smallest doc_id reachable over links.

    Equal fingerprints link, that of empty and null texts (0) like any other. Rows without a
    doc_id take part and can connect others; a class of such rows only has a null component.
    """
    roots = near_duplicates(prints, radius)
    # A row per fingerprint before anything is joined: copies never meet in one task.
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.drop("component_id").join(named, "fp")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest doc_id.

    Among repeated rows of that id one stays; a row without a doc_id stays only if its class
    has no other. The columns are those of ``docs``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", _fingerprints(F.col("text")).alias("fp"))
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id()), "fingerprinted")
    prints = rows.select("_row", "doc_id", "fp")
    roots = near_duplicates(prints, radius)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")))
    classes = prints.groupBy("fp").agg(first.alias("_first"))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    kept = rooted.groupBy(F.coalesce("root", "fp")).agg(F.min("_first")["_row"].alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_doc.*")
