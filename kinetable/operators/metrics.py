"""Classification metrics; every function works per group when ``by`` is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.dims import INTERACTION_CLASSES

LEAST = 1e-15


def confusion(
    predictions: DataFrame, classes: int, by: list[str] | None = None, target: str = "target", pred: str = "pred"
) -> DataFrame:
    """(by, target, pred, n) over all class pairs; rows outside 0..classes-1 are ignored."""
    by = by or []
    inside = F.col(target).between(0, classes - 1) & F.col(pred).between(0, classes - 1)
    counts = predictions.groupBy(*by, target, pred).agg(F.count("*").alias("n")).filter(inside)
    groups = predictions.select(*by).distinct() if by else predictions.sparkSession.range(1).select()
    ids = F.sequence(F.lit(0), F.lit(classes - 1))
    spine = groups.withColumn(target, F.explode(ids)).withColumn(pred, F.explode(ids))
    return spine.join(counts, [*by, target, pred], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )


def accuracy(
    predictions: DataFrame, by: list[str] | None = None, target: str = "target", pred: str = "pred"
) -> DataFrame:
    """Share of exact hits; every row counts, 0 without rows."""
    hit = (F.col(target) == F.col(pred)).cast("double")
    return predictions.groupBy(*(by or [])).agg(
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n")
    )


def precision_recall(
    matrix: DataFrame, by: list[str] | None = None, target: str = "target", pred: str = "pred"
) -> DataFrame:
    """Per class precision, recall (0 where undefined) and support, from a confusion table."""
    by = by or []
    roles = F.array(
        F.struct(F.col(target).alias("class"), F.lit(True).alias("actual")),
        F.struct(F.col(pred).alias("class"), F.lit(False).alias("actual")),
    )
    hit = F.when(F.col(target) == F.col(pred), F.col("n")).otherwise(0)
    sums = (
        matrix.select(*by, hit.alias("hit"), "n", F.explode(roles).alias("r"))
        .groupBy(*by, F.col("r.class").alias("class"))
        .agg(
            F.sum(F.when(F.col("r.actual"), F.col("hit")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("r.actual"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(F.col("r.actual"), 0).otherwise(F.col("n"))).alias("predicted"),
        )
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return sums.select(
        *by,
        "class",
        "support",
        share(F.col("tp"), F.col("predicted")).alias("precision"),
        share(F.col("tp"), F.col("support")).alias("recall"),
    )


def class_name(index: Column, names: list[str] | None = None) -> Column:
    """Given name, else the interaction class, else class_<i>."""
    known = dict(enumerate(INTERACTION_CLASSES)) | dict(enumerate(names or []))
    result = F.concat(F.lit("class_"), index.cast("string"))
    for i, name in sorted(known.items()):
        result = F.when(index == i, F.lit(name)).otherwise(result)
    return result


def report(
    predictions: DataFrame, classes: int, names: list[str] | None = None, by: list[str] | None = None
) -> DataFrame:
    """Class rows plus one ``total`` row per group holding the overall accuracy and count."""
    by = by or []
    matrix = confusion(predictions, classes, by)
    rows = precision_recall(matrix, by).select(
        *by,
        F.col("class"),
        class_name(F.col("class"), names).alias("name"),
        "support",
        "precision",
        "recall",
        F.lit(None).cast("double").alias("accuracy"),
    )
    both = "target", "pred"
    inside = [F.col(c).between(0, classes - 1) for c in both]
    hit = (F.col(both[0]) == F.col(both[1])).cast("double")
    whole = predictions.groupBy(*by).agg(
        F.count(F.when(inside[0] & inside[1], 1)).alias("support"),
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"),
    ).select(
        *by,
        F.lit(-1).alias("class"),
        F.lit("total").alias("name"),
        "support",
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        "accuracy",
    )
    return rows.unionByName(whole)


def split_loss(scored: DataFrame, by: list[str] | None = None, probs: str = "probs", label: str = "label") -> DataFrame:
    """Mean cross-entropy and accuracy in percent of class probabilities; (0, 0) without rows.

    A probability below LEAST counts as LEAST, so that a sure error costs much and not nothing.
    """
    chosen = F.greatest(F.col(probs)[F.col(label)], F.lit(LEAST))
    best = F.array_position(probs, F.array_max(probs)) - 1
    hit = (best == F.col(label)).cast("double")
    return scored.groupBy(*(by or [])).agg(
        F.coalesce(F.avg(-F.ln(chosen)), F.lit(0.0)).alias("loss"),
        F.coalesce(F.avg(hit) * 100.0, F.lit(0.0)).alias("accuracy"),
    )


def best_model(runs: DataFrame, by: list[str] | None = None, model: str = "epoch", score: str = "val_acc") -> DataFrame:
    """Model with the best validation score; the earliest wins ties."""
    return runs.groupBy(*(by or [])).agg(
        F.max_by(model, F.struct(F.col(score), -F.col(model))).alias(model), F.max(score).alias(score)
    )
