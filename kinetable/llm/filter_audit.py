"""Filter interaction audit: what every order of the filters removes, by wide packed counters.

A document's failures are a mask of five bits. Each mask maps to one big integer whose 64-bit
fields hold what happens to such a document at all 600 steps of the 120 orders, so a part's
audit is a sum of integers that is unpacked once. A field counts at most 120 times the part's
documents, which stays below 2**64 up to 2**57 documents: no field runs over into the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm.common import segments, small_batches, store

#: Filters in the order of their mask bits; the last one depends on the whole table.
FILTERS = "ABCDE"
COPY_BIT = 1 << FILTERS.index("E")
FEWEST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD = np.dtype("<u8")
#: Bytes whose words are gathered at a time, result rows handed on at a time.
SEGMENT, ROWS = 1 << 20, 12_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
AUDIT = T.StructType(
    [T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
    + [T.StructField(name, T.LongType()) for name in (*COUNTERS, "shapley")]
)


def text_failures(text: str | None) -> tuple[int, bytes]:
    """Mask of the filters that depend on the text alone, and a 128-bit digest of the text.

    A null text is an empty one. Words are split off segment by segment; only the distinct
    ones are held.
    """
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words, distinct = 0, set()
    for piece in segments(raw, SEGMENT, _SPACE):
        found = piece.split()
        words += len(found)
        distinct.update(found)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    failed = (
        words < FEWEST_WORDS,
        100 * len(distinct) < DISTINCT_PERCENT * words,
        100 * upper > UPPER_PERCENT * len(text or ""),
        len(raw.translate(None, _MARKS)) < len(raw),
    )
    return sum(1 << bit for bit, fails in enumerate(failed) if fails), blake2b(raw, digest_size=16).digest()


@F.pandas_udf(T.StructType([T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())]))
def _failures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_failures(t) for t in texts], columns=["mask", "digest"])


def failing(docs: DataFrame) -> DataFrame:
    """(``part``, ``doc_id``, ``mask``, ``n``): rows of a document that fail the filters of a mask.

    A null source is the part of the empty string. A row is a copy if a smaller ``doc_id`` has
    the identical text; rows that repeat an id are no copies of each other, and a row without
    an id neither is a copy nor makes one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), _failures(F.col("text")).alias("f"))
    rows = rows.groupBy("doc_id", "part", F.col("f.mask").alias("mask"), F.col("f.digest").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    rows = store(rows, "audit-masks")
    # The smallest id joins on digest and id, so the copies of one text spread by their ids.
    firsts = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    mask = F.col("mask").bitwiseOR(F.when(copy, F.lit(COPY_BIT)).otherwise(F.lit(0)))
    # Rows without an id meet no label; their digest keeps them apart in the next shuffle.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.hex("digest")))
    return rows.join(firsts, ["digest", "doc_id"], "left").select(name.alias("_name"), "doc_id", "part", mask.alias("mask"), "n")


def classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(``part``, ``mask``, ``good``, ``toxic``, ``n``): documents by part, failures and labels.

    A document counts as good or toxic if any of its labels says 1. At most 128 rows a part,
    summed before and after the shuffle.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("_name"))
    marks = marks.agg(*[(F.max(c) == 1).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))])
    rows = failing(docs).join(marks, "_name", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return rows.groupBy("part", "mask", *flags).agg(F.sum("n").alias("n"))


@lru_cache(maxsize=1)
def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


@lru_cache(maxsize=None)
def packed(mask: int, good: bool, toxic: bool) -> int:
    """The outcomes of one document with these failures at every step, as fields of one integer."""
    steps = np.zeros((len(orders()) * len(FILTERS), len(COUNTERS)), FIELD)
    taken = np.zeros(len(FILTERS), FIELD)
    at = 0
    for order in orders():
        gone = False
        for letter in order:
            bit = FILTERS.index(letter)
            fails = bool(mask >> bit & 1)
            here = fails and not gone
            steps[at] = (not gone and not fails, here, fails and gone, mask == 1 << bit, here and good, here and toxic)
            taken[bit] += here
            gone |= fails
            at += 1
    return int.from_bytes(steps.tobytes() + taken.tobytes(), "little")


def unpacked(total: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters by step, and removals by filter summed over all orders."""
    steps = len(orders()) * len(FILTERS) * len(COUNTERS)
    fields = np.frombuffer(total.to_bytes((steps + len(FILTERS)) * FIELD.itemsize, "little"), FIELD).astype(np.int64)
    return fields[:steps].reshape(-1, len(COUNTERS)), fields[steps:]


def _audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    letters = np.array([FILTERS.index(x) for order in orders() for x in order])
    names = np.repeat(orders(), len(FILTERS))
    places = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders()))
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        for part, seen in batch.itertuples(index=False):
            total = sum(c["n"] * packed(c["mask"], c["good"], c["toxic"]) for c in seen)
            steps, taken = unpacked(total)
            rows = pd.DataFrame(steps, columns=list(COUNTERS))
            rows.insert(0, "part", part)
            rows.insert(1, "filter_order", names)
            rows.insert(2, "step", places)
            rows["shapley"] = taken[letters]
            waiting.append(rows)
            if len(waiting) * len(rows) >= ROWS:
                yield pd.concat(waiting, ignore_index=True)
                waiting = []
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step.

    ``docs`` has ``doc_id``, ``source`` and ``text``, ``labels`` has ``doc_id``, ``quality`` and
    ``toxic``. ``kept`` counts what is left after the step, ``removed`` what it takes,
    ``redundant`` what fails its filter but went before, ``unique_fails`` what fails only its
    filter, ``good_lost`` and ``toxic_lost`` the labelled ones among the removed, ``shapley`` the
    filter's removals over all orders. Repeated rows each count; an empty table gives no part.
    """
    one = F.collect_list(F.struct("mask", "good", "toxic", "n"))  # at most 128 a part
    return classes(docs, labels).groupBy("part").agg(one.alias("seen")).mapInPandas(_audited, AUDIT)
