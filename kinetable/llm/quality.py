"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic scale."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm.common import small_batches, store

FEATURES, RIDGE, SEED = 384, 1e-3, 7
#: Bins of the raw score over -0.5 to 1.5, from which the isotonic scale is fitted.
BINS = 1000
#: A document is kept from this calibrated score on.
KEEP = 0.3
#: Code points whose classes are counted at a time.
SEGMENT = 300_000
#: Rows whose features are held at a time.
ROWS = 1000

# Classes of characters that are counted, fixed values.
CLASSES = ("lower", "upper", "other letter", "digit", "space", "line end", ".", ",", "!?", "|", "#$%&*", "quotes", "brackets", "<>/\\=", "-_:;@+~^`", "other")
STATISTICS = len(CLASSES) + 13


def _classes() -> np.ndarray:
    out = np.full(0x110000, len(CLASSES) - 1, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = 0 if ch.islower() else 1 if ch.isupper() else 2
        elif ch.isdigit():
            out[c] = 3
        elif ch.isspace():
            out[c] = 5 if ch in "\r\n" else 4
    for k, chars in ((6, "."), (7, ","), (8, "!?"), (9, "|"), (10, "#$%&*"), (11, "\"'«»“”‘’"), (12, "()[]{}"), (13, "<>/\\="), (14, "-_:;@+~^`")):
        for ch in chars:
            out[ord(ch)] = k
    return out


def _word_statistics(text: str) -> list[float]:
    words, lines = text.split(), text.split("\n")
    n = len(words)
    if not n:
        return [0.0] * 12
    distinct = set(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    filled = [x for x in lines if x.strip()]
    lengths = np.fromiter(map(len, filled), np.int64, len(filled))
    shown = sum(map(len, set(filled)))
    return [
        np.log1p(n),
        sizes.mean(),
        sizes.std(),
        np.log1p(sizes.max()),
        len(distinct) / n,
        np.log1p(len(distinct)) / np.log1p(n),
        sum(map(eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.istitle, words)) / n,
        np.log1p(lengths.mean()),
        1.0 - shown / lengths.sum(),
    ]


def _statistics(texts: list[str | None], classes: np.ndarray) -> np.ndarray:
    """One row per text: logarithm of its size, shares of character classes, words and lines."""
    counts = np.zeros((len(texts), len(CLASSES)))
    for k, text in enumerate(texts):
        for at in range(0, len(text or ""), SEGMENT):
            codes = np.frombuffer(text[at : at + SEGMENT].encode("utf-32-le", "surrogatepass"), "<u4")
            counts[k] += np.bincount(classes[codes], minlength=len(CLASSES))
    size = counts.sum(axis=1)
    words = np.array([_word_statistics(t or "") for t in texts]).reshape(len(texts), 12)
    return np.hstack([np.log1p(size)[:, None], counts / np.maximum(size, 1)[:, None], words])


def document_statistics(spark: SparkSession, text: Column) -> Column:
    """Statistics of whole texts as an array; a null text has those of an empty one."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_classes())

    @F.pandas_udf("array<double>")
    def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(_statistics(texts.tolist(), shared.value)))

    return statistics(text)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray


def _features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """A constant, then cosines whose products approximate a Gaussian kernel."""
    z = np.clip((stats - mean) / scale, -6, 6) @ directions + phases
    return np.hstack([np.ones((len(z), 1)), np.sqrt(2.0 / len(phases)) * np.cos(z)])


def _raw(stats: np.ndarray, model: tuple) -> np.ndarray:
    parts = [stats[at : at + ROWS] for at in range(0, len(stats), ROWS)]
    return np.concatenate([np.zeros(0), *(_features(part, *model[:4]) @ model[4] for part in parts)])


def _calibrated(stats: np.ndarray, model: tuple) -> np.ndarray:
    return np.clip(np.interp(_raw(stats, model), model[5], model[6]), 0.0, 1.0)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int64)


def _stacked(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()) if len(values) else np.zeros((0, STATISTICS))


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Nearest non-decreasing values, by pooling neighbours that stand the wrong way round."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (v1, w1, n1), (v2, w2, n2) = blocks[-2:]
            blocks[-2:] = [[(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all rows (``doc_id``, ``stats``) that ``labels`` (``doc_id``, ``label``) marks.

    Labels of a repeated id are averaged, null labels and ids left out. Each task adds up its
    part of the normal equations; one matrix row of every task meets in a group, and the sums,
    of fixed size, are solved on the driver. Without labelled rows there is no model.
    """
    spark = rows.sparkSession
    marks = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.avg("label").alias("label"))
    known = store(rows.select("doc_id", "stats").join(marks, "doc_id").select("stats", "label"), "labelled")
    each = [F.get("stats", k) for k in range(STATISTICS)]
    totals = known.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{k}") for k, c in enumerate(each)],
        *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(each)],
    ).first()
    if not totals["n"]:
        return None
    mean = np.array([totals[f"m{k}"] for k in range(STATISTICS)])
    scale = np.array([max(totals[f"s{k}"], 1e-6) for k in range(STATISTICS)])
    random = np.random.default_rng(SEED)
    directions = random.standard_normal((STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
    kernel = (mean, scale, directions, random.uniform(0, 2 * np.pi, FEATURES))
    shared = spark.sparkContext.broadcast(kernel)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                x = _features(_stacked(part["stats"]), *shared.value)
                sums += x.T @ np.hstack([x, part["label"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"i": np.arange(len(sums)), "sums": list(sums)})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": part["i"].iloc[:1], "sums": [np.stack(part["sums"].to_numpy()).sum(axis=0)]})

    kind = "i long, sums array<double>"
    sums = known.mapInPandas(summed, kind).groupBy("i").applyInPandas(added, kind).orderBy("i").toPandas()
    both = np.stack(sums["sums"].to_numpy())
    left, right = both[:, :-1], both[:, -1]
    ridge = np.full(len(left), RIDGE * totals["n"] / FEATURES)
    ridge[0] = 0
    weights = np.linalg.solve(left + np.diag(ridge) + 1e-9 * np.eye(len(left)), right)
    scorer = spark.sparkContext.broadcast((*kernel, weights))

    @F.pandas_udf(T.LongType())
    def binned(stats: pd.Series) -> pd.Series:
        return pd.Series(_bin(_raw(_stacked(stats), scorer.value)))

    bins = known.groupBy(binned("stats").alias("bin")).agg(F.avg("label").alias("label"), F.count(F.lit(1)).alias("n"))
    bins = bins.orderBy("bin").toPandas()
    middle = (bins["bin"].to_numpy(float) + 0.5) * 2 / BINS - 0.5
    return Model(*kernel, weights, middle, isotonic(bins["label"].to_numpy(float), bins["n"].to_numpy(float)))


def score_text(spark: SparkSession, text: Column, model: Model | None) -> Column:
    """``score`` of a text's statistics in one step, so that a task needs one Python worker."""
    if model is None:
        return F.lit(0.5)
    small_batches(spark)
    shared = spark.sparkContext.broadcast((tuple(model), _classes()))

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        own, classes = shared.value
        return pd.Series(_calibrated(_statistics(texts.tolist(), classes), own))

    return scored(text)


def score(spark: SparkSession, stats: Column, model: Model | None) -> Column:
    """Calibrated score from 0 to 1; 0.5 for every document if there is no model."""
    if model is None:
        return F.lit(0.5)
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.pandas_udf(T.DoubleType())
    def scored(values: pd.Series) -> pd.Series:
        return pd.Series(_calibrated(_stacked(values), shared.value))

    return scored(stats)
