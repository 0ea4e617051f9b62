"""Near copies by exact Jaccard similarity of five-word shingles.

Candidates are the neighbours of each SimHash in the Gray-ordered hierarchical index of
:mod:`kinetable.llm.simhash`; MinHash bands find the similar sets whose fingerprints lie further apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from kinetable.llm.common import ROWS_A_FILE, small_batches, store
from kinetable.llm.components import components
from kinetable.llm.simhash import RADIUS, index, majority
from kinetable.llm.simhash import links as fingerprint_links
from kinetable.session import discard

SHINGLE, SIMILARITY, HASH_SEED = 5, 0.8, 42
#: Texts of the least similarity share no band with a probability of (1 - 0.8^4)^32 = 5e-8.
BANDS, WIDTH = 32, 4
#: Shingles that are hashed at a time, leaders a text is tried with first.
CHUNK, LEADERS = 2048, 4
#: Narrow rows that a whole document or its bands weigh when tables are cut into files.
WIDE = 4
#: Texts and shingles of a block: what one comparison holds of either side.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19

_RANDOM = np.random.default_rng(5)
_XOR = _RANDOM.integers(0, 1 << 64, BANDS * WIDTH, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, BANDS * WIDTH, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of all runs of five words, ASCII letters lower-cased.

    A shorter text is one shingle; without words there is none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    count = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.fromiter(map(xxh64_intdigest, runs, repeat(HASH_SEED)), np.uint64, count))


def sketch(own: np.ndarray) -> tuple[int, int, int, list[int]]:
    """A number of the whole set, its size, its SimHash and one number of each band of its MinHash; (0, 0, 0, []) for the empty set."""
    if not len(own):
        return 0, 0, 0, []
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max)
    for at in range(0, len(own), CHUNK):
        mixed = (own[at : at + CHUNK, None] ^ _XOR) * _ODD
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=0))
    bands = [xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, WIDTH))]
    signed = np.array([xxh64_intdigest(own.tobytes(), HASH_SEED), *bands], np.uint64).view(np.int64).tolist()
    return signed[0], len(own), majority(own), signed[1:]


@F.pandas_udf(T.StructType([*[T.StructField(c, T.LongType()) for c in ("key", "size", "fp")], T.StructField("bands", T.ArrayType(T.LongType()))]))
def _sketches(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sketch(shingles(t)) for t in texts], columns=["key", "size", "fp", "bands"])


@F.pandas_udf(T.BinaryType())
def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)


def enough(common: np.ndarray | int, one: np.ndarray | int, two: np.ndarray | int) -> np.ndarray | bool:
    """Whether two sets of these sizes with so many common shingles have the least similarity."""
    return common >= SIMILARITY * (one + two - common) - 1e-9


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = ((_numbers(x), _numbers(y)) for x, y in zip(batch["u_set"], batch["v_set"], strict=True))
        near = [bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))) for x, y in sets]
        yield batch.loc[near, ["u", "v"]]


def linked(members: list[dict]) -> list[tuple[int, int]]:
    """Links that connect each member that ``asks`` with the similar ones that ``answer``.

    Members are met through their single shingles, so sets without a common one cost nothing;
    a pair is left out if its labels or the links found so far connect it already.
    """
    answers = [m for m in members if m["answers"]]
    sets = [_numbers(m["set"]) for m in answers]
    sizes = np.array([len(x) for x in sets])
    owners, shingles_ = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(shingles_, kind="stable")
    owners, shingles_ = owners[order], shingles_[order]
    names, of = np.unique([m["label"] for m in members], return_inverse=True)
    of = dict(zip((m["key"] for m in members), of.tolist(), strict=True))
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for member in members:
        if not member["asks"]:
            continue
        own, key = _numbers(member["set"]), member["key"]
        low, high = np.searchsorted(shingles_, own, "left"), np.searchsorted(shingles_, own, "right")
        count = high - low
        at = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
        common = np.bincount(owners[at], minlength=len(sets))
        for i in np.flatnonzero(enough(common, sizes, len(own))).tolist():
            x, y = root(of[key]), root(of[answers[i]["key"]])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((key, answers[i]["key"]))
    return out


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [link for members in batch["members"] for link in linked(members)]
        if out:
            yield pd.DataFrame(out, columns=["u", "v"])


def _blocks(count: Column, shingles_: Column) -> Column:
    return F.ceil(F.greatest(count / BLOCK, shingles_ / BLOCK_SHINGLES, F.lit(1.0))).cast("long")


def neighbours(classes: DataFrame, rows: int | None = None, radius: int = RADIUS) -> DataFrame:
    """Pairs (u < v) of sets that connect all sets with fingerprints at most ``radius`` bits apart, from the Gray-ordered index."""
    shown = classes.where("size > 0").select("key", "fp")
    first = store(shown.groupBy("fp").agg(F.min("key").alias("first")), "fingerprints", rows)
    equal = shown.join(first, "fp").select("key", F.col("first").alias("other"))
    apart = fingerprint_links(index(first, rows), radius).toDF("fp", "other_fp")
    other = first.select(F.col("fp").alias("other_fp"), F.col("first").alias("other"))
    apart = apart.join(first.withColumnRenamed("first", "key"), "fp").join(other, "other_fp").select("key", "other")
    pairs = equal.unionByName(apart).where("key <> other")
    return pairs.select(F.least("key", "other").alias("u"), F.greatest("key", "other").alias("v")).distinct()


def links(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (u, v) that connect all sets of at least the similarity that are neighbours or share a band.

    ``classes``: ``key``, ``size``, ``fp``, ``bands`` and one ``_row`` of each distinct set; ``rows``: ``_row``
    and ``text``. Each set is first tried with its neighbours by fingerprint and with a few leaders
    of its buckets, which connects large groups in linear time. Buckets with the same members are
    one bucket. In a bucket that this leaves in several parts, every set outside the largest part is
    then compared with all sets of the bucket, in blocks of a bounded size: nothing is left out.
    """
    members = classes.select("key", "size", F.explode("bands").alias("value"))
    buckets = members.groupBy("value").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("mixed")
    )
    # Ends, count and mixed hashes tell lists of members apart.
    buckets = buckets.where("first <> last").groupBy("first", "last", "n", "mixed").agg(F.min("value").alias("value")).drop("n", "mixed")
    number = classes.count()
    shared = store(members.join(buckets, "value"), "shared-bands", number)
    gray = store(neighbours(classes, number), "gray-pairs", number)
    asked = shared.select("key").unionByName(gray.select(F.explode(F.array("u", "v")).alias("key"))).distinct()
    wanted = classes.select("key", "_row").join(asked, "key", "left_semi").withColumnRenamed("key", "_key")
    sets = rows.select("_row", "text").join(wanted, "_row").select(F.col("_key").alias("key"), _sets(F.col("text")).alias("set"))
    sets = store(sets, "shingle-sets", 16 * number)  # a set is many times a narrow row

    leaders = shared.select("key", F.explode(F.array("first", "last")).alias("leader")).where("key <> leader")
    often = Window.partitionBy("key").orderBy(F.desc("n"), "leader")
    leaders = leaders.groupBy("key", "leader").agg(F.count(F.lit(1)).alias("n")).withColumn("_place", F.row_number().over(often))
    pairs = leaders.where(F.col("_place") <= LEADERS).select(F.least("key", "leader").alias("u"), F.greatest("key", "leader").alias("v"))
    pairs = pairs.unionByName(gray).distinct()
    one, two = (sets.select(F.col("key").alias(x), F.col("set").alias(f"{x}_set")) for x in ("u", "v"))
    tried = pairs.join(one, "u").join(two, "v").select("u", "v", "u_set", "v_set")
    tried = store(tried.mapInPandas(_tried, "u long, v long"), "first-links", number)

    roots = components(tried, number).withColumnRenamed("node", "key")
    labelled = shared.join(roots, "key", "left").select("value", "key", "size", F.coalesce("root", "key").alias("label"))
    labelled = store(labelled, "labelled", number)
    parts = labelled.groupBy("value", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    parts = parts.groupBy("value").agg(
        F.max(F.struct("n", "size", "label")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")
    )
    unsettled = parts.where("parts > 1").select(
        "value",
        F.col("most.label").alias("_most"),
        _blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("_asking"),
        _blocks(F.col("n"), F.col("size")).alias("_answering"),
    )
    # A cell compares the sets of block a that ask with the sets of block b.
    place = F.xxhash64("key")
    asks = F.when(F.col("label") != F.col("_most"), F.pmod(place, "_asking"))
    answers = F.pmod(place, "_answering")
    met = labelled.join(unsettled, "value").select("value", "key", "label", "_asking", "_answering", asks.alias("_a"), answers.alias("_b"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_asking") - 1), lambda a: F.struct(a.alias("a"), F.col("_b").alias("b")))
    more = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_answering") - 1), lambda b: F.struct(F.col("_a").alias("a"), b.alias("b")))
    met = met.withColumn("cell", F.explode(F.when(F.col("_a").isNull(), cells).otherwise(F.array_union(cells, more))))
    flags = [F.coalesce(F.col("_a") == F.col("cell.a"), F.lit(False)).alias("asks"), (F.col("_b") == F.col("cell.b")).alias("answers")]
    met = met.select("value", "cell", "key", "label", *flags).join(sets, "key")
    gathered = met.groupBy("value", "cell").agg(F.collect_list(F.struct("key", "label", "asks", "answers", "set")).alias("members"))
    gathered = gathered.where(F.exists("members", lambda m: m["asks"]) & F.exists("members", lambda m: m["answers"]))
    found = store(tried.unionByName(gathered.select("members").mapInPandas(_compared, "u long, v long")), "near-links", number)
    discard(shared, gray, sets, tried, labelled)
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id.

    Texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8 link;
    texts without words are alike. Among repeated rows of an id one stays; a row without a
    doc_id stays only if its class has no other. The columns are those of ``docs``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", _sketches(F.col("text")).alias("s"))
    rows = rows.select("_doc", "doc_id", *[F.col(f"s.{c}").alias(c) for c in ("key", "size", "fp", "bands")])
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id()), "sketched")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")))
    classes = rows.groupBy("key").agg(first.alias("_first"), *[F.any_value(c).alias(c) for c in ("size", "fp", "bands")])
    number = WIDE * rows.count()
    classes = store(classes.withColumn("_row", F.col("_first._row")), "sets", number)
    found = links(classes, rows.select("_row", F.col("_doc.text").alias("text")))
    roots = components(found, number)
    discard(found)
    rooted = classes.select("key", "_first").join(roots.withColumnRenamed("node", "key"), "key", "left")
    kept = rooted.groupBy(F.coalesce("root", "key")).agg(F.min("_first")["_row"].alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_doc.*").coalesce(number // ROWS_A_FILE + 1)
