"""Target-distribution importance resampling by hashed runs of words.

Words come from the pre-tokenisation of an untrained ``Split``; windows over their offsets are
the features. Bucket histograms of the raw and the target texts give each bucket a gain, a
document's weight is the mean of its gains, and seeded Gumbel noise draws without replacement.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from kinetable.llm.common import numbered, segments, small_batches, store

#: Runs of one word up to this many, buckets, seed of the noise, share drawn in percent.
RUN, BUCKETS, SEED, PERCENT = 1, 10_000, "2024", 10
#: A document is drawn only from this many words on.
FEWEST_WORDS = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Characters that are split at a time, features whose buckets are remembered.
SEGMENT, KNOWN = 1 << 18, 500_000
FEATURES = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())]
)


@lru_cache(maxsize=1)
def _splitter() -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


class _Buckets(dict):
    """Bucket of each feature met so far."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, feature: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[feature] = crc32(feature.encode("utf-8", "surrogatepass")) % self.count
        return found


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def featured(text: str | None, known: _Buckets, run: int) -> tuple[int, int, bytes]:
    """Words, features and the features' buckets of a whole text; ASCII letters are lower-cased.

    A feature is the text from the first offset of a window to its last one, with one space for
    each gap. A null text has none.
    """
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if text else ""
    words, out, lead = 0, [], []
    for piece in segments(lowered, SEGMENT, _GAP):
        # The last words of the segment before lead, for the windows that cross the cut.
        piece = " ".join([*lead, piece])
        split = _splitter().pre_tokenize_str(piece)
        words += len(split) - len(lead)
        found = [known[word] for word, _ in split[len(lead) :]]  # a window of one word is the word
        ends = [place for _, place in split] if run > 1 else []
        for size in range(2, run + 1):
            first = max(0, len(lead) - size + 1)
            windows = zip(ends[first:], ends[first + size - 1 :], strict=False)
            found += [known[_GAP.sub(" ", piece[start:end])] for (start, _), (_, end) in windows]
        out.append(np.array(found, _kind(known.count)))
        lead = [word for word, _ in split[1 - run :]] if run > 1 else []
    joined = np.concatenate(out) if out else np.empty(0, _kind(known.count))
    return words, len(joined), joined.tobytes()


def features(spark: SparkSession, text: Column, run: int = RUN, buckets: int = BUCKETS) -> Column:
    """(``n_words``, ``n_features``, ``buckets``) of a text."""
    small_batches(spark)

    @F.pandas_udf(FEATURES)
    def found(texts: pd.Series) -> pd.DataFrame:
        known = _Buckets(buckets)
        return pd.DataFrame([featured(t, known, run) for t in texts], columns=FEATURES.names)

    return found(text)


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; a task hands on one row per bucket, the driver gets ``buckets`` rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), _kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = rows.select("buckets").mapInArrow(counted, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's share to the raw one, smoothed by one, per bucket."""
    buckets, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = [(float(t + 1) * (s_all + buckets)) / (float(s + 1) * (t_all + buckets)) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _weight(gain: np.ndarray) -> Column:
    @F.pandas_udf("long")
    def mean(found: pd.Series) -> pd.Series:
        each = (np.frombuffer(x, _kind(len(gain))) for x in found)
        return pd.Series([int(gain[x].sum()) // len(x) if len(x) else 0 for x in each], dtype="int64")

    return mean(F.col("buckets"))


def noise(name: str) -> int:
    """Thousandths of a Gumbel number that the name decides."""
    h = int(sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


@F.pandas_udf(T.LongType())
def _noise(names: pd.Series) -> pd.Series:
    return pd.Series([noise(x) for x in names], dtype="int64")


def resample(
    docs: DataFrame,
    target: DataFrame,
    run: int = RUN,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    fewest: int = FEWEST_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """All ``docs`` (``doc_id``, ``text``) with ``n_features``, ``weight``, ``score`` and ``rank``.

    ``target`` is a table with a column ``text``. The given share of the documents with at least
    ``fewest`` words is drawn by score, ties to the smaller id; ``rank`` counts from 1 and is null
    for the others. A null or empty text has weight 0. Rows that repeat an id have the same noise
    and are ranked one after the other; a null id has the noise of the bare seed and stands last
    among ties. Other columns are kept, those named like a result are replaced. Empty tables are
    fine on either side.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_features", "weight", "score", "rank", "buckets", "_f")
    rows = docs.drop("text").columns
    found = docs.withColumn("_f", features(spark, F.col("text"), run, buckets)).select(*rows, "_f.*")
    found = store(found, "resampling-buckets")
    wanted = target.select(features(spark, F.col("text"), run, buckets).alias("_f")).select("_f.*")
    gain = gains(histogram(found, buckets), histogram(wanted, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    scored = found.withColumn("weight", _weight(gain)).withColumn("score", F.col("weight") + _noise(name))
    scored = scored.withColumn("_few", F.col("n_words") < fewest).drop("n_words", "buckets")
    scored = store(scored, "resampling-scores")
    eligible = scored.where(~F.col("_few")).count()
    order = [F.col("_few").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    place = numbered(scored, order, "resampling-ranks", "_place")
    drawn = ~F.col("_few") & (F.col("_place") < percent * eligible // 100)
    return place.withColumn("rank", F.when(drawn, F.col("_place") + 1)).drop("_few", "_place")
