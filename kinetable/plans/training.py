"""Training and evaluation of clip classifiers with Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators.metrics import confusion, report, split_loss
from kinetable.operators.splits import assign_holdout, assign_split, select_split
from kinetable.session import materialize


def train(samples: DataFrame, label: str = "label", iterations: int = 100, penalty: float = 1e-4) -> PipelineModel:
    """Standardized logistic regression over the ``features`` array."""
    stages = [
        StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="scaled", labelCol="target", maxIter=iterations, regParam=penalty
        ),
    ]
    rows = samples.select(array_to_vector("features").alias("vector"), F.col(label).cast("double").alias("target"))
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, samples: DataFrame, label: str = "label") -> DataFrame:
    """Samples with target, pred and class probabilities."""
    rows = samples.select(
        *[c for c in samples.columns if c not in ("features", "target")],
        array_to_vector("features").alias("vector"),
        F.col(label).cast("int").alias("target"),
    )
    scored = model.transform(rows)
    return scored.select(
        *[c for c in rows.columns if c != "vector"],
        F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability").alias("probs"),
    )


def train_split(
    samples: DataFrame, item: str = "clip_id", label: str = "label", seed: int = 42
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Train on the train split: (model, validation loss and accuracy, test predictions)."""
    split = materialize(assign_split(samples, item, seed), "split")
    model = train(select_split(split, "train"), label)
    val = split_loss(predict(model, select_split(split, "val"), label), label="target")
    return model, val, predict(model, select_split(split, "test"), label)


def pooled_evaluation(
    samples: DataFrame, item: str = "clip_id", label: str = "label", seed: int = 42
) -> DataFrame:
    """Predictions on the held-out fifth of the pooled samples; empty below two samples."""
    split = materialize(assign_holdout(samples, item, seed), "pooled")
    if split.isEmpty():
        return split.select(item, F.lit(0).alias("target"), F.lit(0).alias("pred"))
    model = train(split.filter("split = 'train'"), label)
    return predict(model, split.filter("split = 'val'"), label).select(item, "target", "pred")


def leave_one_out(
    samples: DataFrame, datasets: list[str], item: str = "clip_id", label: str = "label"
) -> DataFrame:
    """For each named dataset: train on the others, predict it. (dataset, item, target, pred).

    A dataset is skipped when it or the rest is empty.
    """
    pooled = materialize(samples.filter(F.col("dataset").isin(datasets)), "pooled")
    parts = []
    for held in datasets:
        rest, own = pooled.filter(F.col("dataset") != held), pooled.filter(F.col("dataset") == held)
        if rest.isEmpty() or own.isEmpty():
            continue
        parts.append(predict(train(rest, label), own, label).select("dataset", item, "target", "pred"))
    if not parts:
        return pooled.limit(0).select("dataset", item, F.lit(0).alias("target"), F.lit(0).alias("pred"))
    return reduce(DataFrame.unionByName, parts)


def leave_one_out_report(predictions: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(confusion, report) per held-out dataset."""
    return (
        confusion(predictions, len(names), ["dataset"]),
        report(predictions, len(names), names, ["dataset"]),
    )
