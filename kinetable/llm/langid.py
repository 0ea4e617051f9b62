"""Language identification by interpolated Kneser-Ney models over characters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm.common import small_batches, store

ORDER = 4
#: n-grams of each order and language are kept by a hash of this many bits, which bounds a model.
SLOT_BITS = 18
#: Languages a model may hold; more raise an error.
MAX_LANGUAGES = 64
#: Distinct n-grams gathered by a task before it hands them on.
GATHERED = 200_000
#: Code points that are worked on at a time.
SEGMENT = 300_000
#: Deviations above its language's mean at which a text is rejected.
REJECT = 8.0
#: Inverse temperatures among which calibration chooses.
SCALES = tuple(float(2**k) for k in range(-2, 9))


def _letters() -> np.ndarray:
    """For every code point its lower-case letter in 16 bits, 0 for anything else."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = (ord(chr(c).lower()[0]) % 0xFFFF) + 1 if c > 0xFFFE else ord(chr(c).lower()[0])
    return out


def grams(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams of the texts as 64-bit keys, last letter lowest, and the text of each.

    Runs of anything but letters count as one space; a text starts after spaces. A text
    without a letter has none.
    """
    whole = "".join(t or "" for t in texts)
    sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    codes = letters[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")]
    doc = np.repeat(np.arange(len(texts)), sizes)
    has = np.zeros(len(texts), bool)
    has[doc[codes > 0]] = True
    first = np.ones(len(codes), bool)
    first[1:] = doc[1:] != doc[:-1]
    previous = np.concatenate([np.zeros(1, np.uint16), codes])[: len(codes)]
    previous[first] = 0
    keep = ((codes > 0) | (previous > 0)) & has[doc]
    codes, doc = codes[keep].astype(np.uint64), doc[keep]
    key, shifted, same = codes.copy(), codes, np.ones(len(codes), bool)
    for back in range(1, ORDER):
        shifted = np.concatenate([np.zeros(1, np.uint64), shifted])[: len(codes)]
        same = same & (np.concatenate([np.full(back, -1), doc])[: len(doc)] == doc)
        key |= np.where(same, shifted, 0).astype(np.uint64) << np.uint64(16 * back)
    return key.view(np.int64), doc


def segments(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The texts in lots of about SEGMENT code points, each with the indexes of its owners.

    A longer text is read in segments, each of which starts after spaces like a text.
    """
    owners, parts, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text or ""), SEGMENT):
            parts.append(text[at : at + SEGMENT])
            owners.append(k)
            size += len(parts[-1])
            if size >= SEGMENT:
                yield np.array(owners), parts
                owners, parts, size = [], [], 0
    if parts:
        yield np.array(owners), parts


def gram_counts(docs: DataFrame) -> DataFrame:
    """(``lang``, ``key``, ``n``) of all 4-grams in whole texts, by language."""
    schema = "lang string, key long, n long"
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_letters())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, held, size = shared.value, {}, 0

        def handed() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                total = pd.concat(parts).groupby(level=0).sum()
                yield pd.DataFrame({"lang": lang, "key": total.index.to_numpy(), "n": total.to_numpy()})

        for batch in batches:
            langs, names = pd.factorize(batch["lang"])
            for owners, parts in segments(batch["text"].tolist()):
                key, part = grams(parts, letters)
                which = langs[owners[part]]
                for k, lang in enumerate(names):
                    codes, keys = pd.factorize(key[which == k])
                    held.setdefault(lang, []).append(pd.Series(np.bincount(codes, minlength=len(keys)), index=keys))
                    size += len(keys)
            if size > GATHERED:
                yield from handed()
                held, size = {}, 0
        yield from handed()

    gathered = docs.select("lang", "text").mapInPandas(count, schema)
    return gathered.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def slots(keys: np.ndarray, order: int) -> np.ndarray:
    """Hash of a key of an order, in SLOT_BITS bits; the model is keyed by it."""
    z = keys.astype(np.uint64) ^ np.uint64(order * 0x9E3779B97F4A7C15 % 2**64)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@F.pandas_udf(T.LongType())
def _hashed(keys: pd.Series, order: pd.Series) -> pd.Series:
    out = np.zeros(len(keys), np.int64)
    for n in order.unique():
        at = (order == n).to_numpy()
        out[at] = slots(keys.to_numpy()[at], int(n))
    return pd.Series(out)


def model_rows(counts: DataFrame) -> DataFrame:
    """(``lang``, ``kind``, ``order``, ``slot``, ``n``, ``types``) of the modified counts.

    The highest order has its counts; a lower order counts the different letters before an
    n-gram (its continuations). Kind ``g`` holds n-grams, kind ``c`` contexts with their total
    and the number of different n-grams that continue them.
    """
    levels, level = [], counts
    for order in range(ORDER, 0, -1):
        mask = -1 if order == ORDER else (1 << (16 * order)) - 1
        level = level.select("lang", F.col("key").bitwiseAND(F.lit(mask)).alias("key"), "n")
        if order < ORDER:
            level = level.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n"))
        context = F.shiftrightunsigned("key", 16) if order > 1 else F.lit(0).cast("long")
        gram = level.select("lang", F.lit("g").alias("kind"), F.lit(order).alias("order"), "key", "n", F.lit(1).cast("long").alias("types"))
        total = level.groupBy("lang", context.alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))
        levels += [gram, total.select("lang", F.lit("c").alias("kind"), F.lit(order).alias("order"), "key", "n", "types")]
    rows = levels[0]
    for other in levels[1:]:
        rows = rows.unionByName(other)
    rows = rows.withColumn("slot", _hashed("key", "order"))
    return rows.groupBy("lang", "kind", "order", "slot").agg(
        F.sum("n").alias("n"),
        F.sum("types").alias("types"),
        F.sum((F.col("n") == 1).cast("long")).alias("ones"),
        F.sum((F.col("n") == 2).cast("long")).alias("twos"),
    )


class Model(NamedTuple):
    """Per language and order sorted slots with their counts: n-grams (slots, n) and contexts
    (slots, total, number of continuations), and the order's discount."""

    languages: list[str]
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    contexts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    discounts: list[list[float]]
    letters: int


def _at(slots_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(slots_, wanted), max(len(slots_) - 1, 0))
    return at, slots_[at] == wanted if len(slots_) else np.zeros(len(wanted), bool)


def costs(model: tuple, keys: np.ndarray) -> np.ndarray:
    """Minus the log probability of each 4-gram's last letter, a row per language."""
    languages, gram_arrays, context_arrays, discounts, letters = model
    hashed = []
    for order in range(1, ORDER + 1):
        part = keys & np.int64((1 << (16 * order)) - 1) if order < ORDER else keys
        context = (part.view(np.uint64) >> np.uint64(16)).view(np.int64) if order > 1 else np.zeros_like(part)
        hashed.append((slots(part, order), slots(context, order)))
    out = np.empty((len(languages), len(keys)))
    for k in range(len(languages)):
        p = np.full(len(keys), 1.0 / (letters + 1))
        for order, (gram, context) in enumerate(hashed):
            slots_, n = gram_arrays[k][order]
            at, known = _at(slots_, gram)
            count = np.where(known, n[at], 0.0) if len(n) else np.zeros(len(keys))
            slots_, total, types = context_arrays[k][order]
            at, known = _at(slots_, context)
            if not known.any():
                continue
            d = discounts[k][order]
            p = np.where(known, (np.maximum(count - d, 0.0) + d * types[at] * p) / total[at], p)
        out[k] = -np.log(p)
    return out


def train(docs: DataFrame, rows: int | None = None) -> Model:
    """Models of every language among the rows with a non-null ``lang``, from all their texts.

    Spark makes the counts over all rows; what reaches the driver is bounded by
    2 * ORDER * 2**SLOT_BITS rows a language for any corpus. The absolute discount of an order
    is n1 / (n1 + 2 n2). No rows give a model without languages.
    """
    counts = store(gram_counts(docs.where(F.col("lang").isNotNull())), "grams", rows)
    letters = counts.select(F.col("key").bitwiseAND(F.lit(0xFFFF))).distinct().count()
    found = counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if found > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = model_rows(counts).toArrow().to_pandas()
    model = Model(sorted(rows["lang"].unique()), [], [], [], letters)
    for lang in model.languages:
        own, per_gram, per_context, per_discount = rows[rows["lang"] == lang], [], [], []
        for order in range(1, ORDER + 1):
            here = own[own["order"] == order].sort_values("slot")
            g, c = here[here["kind"] == "g"], here[here["kind"] == "c"]
            ones, twos = int(g["ones"].sum()), int(g["twos"].sum())
            per_discount.append(min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5)
            per_gram.append((g["slot"].to_numpy(np.int64), g["n"].to_numpy(float)))
            per_context.append((c["slot"].to_numpy(np.int64), c["n"].to_numpy(float), c["types"].to_numpy(float)))
        model.grams.append(per_gram)
        model.contexts.append(per_context)
        model.discounts.append(per_discount)
    return model


def measured(spark: SparkSession, text: Column, model: Model) -> Column:
    """Struct of a whole text: ``n`` letters and spaces, ``costs`` (mean cost per language) and
    ``spread`` (variance of the lowest language's costs). Without a letter ``n`` is 0."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((tuple(model), _letters()))
    kind = "struct<n:long,costs:array<double>,spread:double>"
    languages = len(model.languages)

    @F.pandas_udf(kind)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, letters = shared.value
        for batch in batches:
            texts = batch.tolist()
            n, total, square = np.zeros(len(texts), np.int64), np.zeros((languages, len(texts))), np.zeros((languages, len(texts)))
            for owners, parts in segments(texts):
                key, part = grams(parts, letters)
                if not languages or not len(key):
                    continue
                doc = owners[part]
                codes, distinct = pd.factorize(key)
                cost = costs(own, distinct)
                n += np.bincount(doc, minlength=len(texts))
                for k in range(languages):
                    each = cost[k][codes]
                    total[k] += np.bincount(doc, each, len(texts))
                    square[k] += np.bincount(doc, each * each, len(texts))
            mean = total / np.maximum(n, 1)
            best = mean.argmin(axis=0) if languages else np.zeros(len(texts), np.int64)
            at = np.arange(len(texts))
            spread = np.maximum(square[best, at] / np.maximum(n, 1) - mean[best, at] ** 2, 0.0) if languages else np.zeros(len(texts))
            yield pd.DataFrame({"n": n, "costs": list(mean.T), "spread": spread})

    return measure(text)


class Calibration(NamedTuple):
    """The scale that turns costs into probabilities, and for each language the mean of its
    texts' costs with their variance between texts and within a text."""

    scale: float
    mean: dict[str, float]
    between: dict[str, float]
    within: dict[str, float]


def _posterior(scale: float) -> Column:
    """Probability of the lowest cost's language."""
    low = F.array_min("m.costs")
    return 1.0 / F.aggregate("m.costs", F.lit(0.0), lambda s, c: s + F.exp((low - c) * F.lit(scale)))


def for_calibration(key: Column) -> Column:
    """Whether a row with this crc of its id calibrates (one in eight) instead of training."""
    return F.coalesce(F.shiftright(key, 2) % 8 == 0, F.lit(False))


def calibrate(rows: DataFrame, model: Model) -> Calibration:
    """From rows (``lang``, ``m`` as ``measured`` gives it) that the models were not trained on."""
    rows = rows.where((F.col("m.n") > 0) & F.col("lang").isNotNull())
    names = F.array(*[F.lit(x) for x in model.languages]) if model.languages else F.array().cast("array<string>")
    rows = rows.withColumn("_own", F.get("m.costs", F.array_position(names, F.col("lang")).cast("int") - 1))
    rows = rows.withColumn("_low", F.array_min("m.costs"))
    losses = [
        F.sum(F.lit(s) * (F.col("_own") - F.col("_low")) - F.log(_posterior(s))).alias(f"loss{k}") for k, s in enumerate(SCALES)
    ]
    first = rows.where(F.col("_own").isNotNull()).agg(*losses).first()
    lost = [(v, s) for v, s in zip(first, SCALES, strict=True) if v is not None]
    right = rows.where(F.col("_own") == F.col("_low")).groupBy("lang").agg(
        F.avg("_own").alias("mean"), F.var_pop("_own").alias("both"), F.avg("m.spread").alias("within"), F.avg(1 / F.col("m.n")).alias("per")
    )
    found = right.collect()  # one row per language, at most MAX_LANGUAGES
    return Calibration(
        min(lost)[1] if lost else 1.0,
        {r["lang"]: r["mean"] for r in found},
        {r["lang"]: max(r["both"] - r["within"] * r["per"], 0.0) for r in found},
        {r["lang"]: r["within"] for r in found},
    )


def identified(rows: DataFrame, model: Model, calibration: Calibration) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (its probability) and ``accepted`` to rows with ``m``.

    The language is that of the lowest length-normalised cross-entropy, ties going to the first
    by name; ``und``, score 0 and not accepted for a null text or one without a letter. A text
    is rejected if its cross-entropy stands REJECT deviations above those of its language, for
    its length.
    """
    if not model.languages:
        return rows.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "accepted": F.lit(False)})
    low = F.array_min("m.costs")
    some = F.coalesce(F.col("m.n") > 0, F.lit(False))
    names = F.array(*[F.lit(x) for x in model.languages])
    picked = F.element_at(names, F.array_position("m.costs", low).cast("int"))
    limit = F.lit(None).cast("double")
    for lang, mean in calibration.mean.items():
        deviation = F.sqrt(F.lit(calibration.between[lang]) + F.lit(calibration.within[lang]) / F.col("m.n"))
        limit = F.when(picked == lang, F.lit(mean) + F.lit(REJECT) * deviation).otherwise(limit)
    return rows.drop("lang_pred", "score", "accepted").withColumns(
        {
            "lang_pred": F.when(some, picked).otherwise(F.lit("und")),
            "score": F.when(some, _posterior(calibration.scale)).otherwise(F.lit(0.0)),
            "accepted": some & F.coalesce(low <= limit, F.lit(True)),
        }
    )
