"""Scorers: functions that add ``prob`` to a table with a ``features`` array."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.dims import AGGRESSIVE
from kinetable.functions.numeric import sigmoid

Scorer = Callable[[DataFrame], DataFrame]


def linear_scorer(weights: list[float], bias: float = 0.0) -> Scorer:
    """Logistic score of the features as plain column arithmetic."""

    def score(df: DataFrame) -> DataFrame:
        value = F.lit(float(bias))
        for i, weight in enumerate(weights):
            value = value + F.col("features")[i] * F.lit(float(weight))
        return df.withColumn("prob", sigmoid(value))

    return score


def ml_scorer(model: PipelineModel) -> Scorer:
    """Probability of the aggressive class from a fitted Spark ML classifier."""

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(df.withColumn("vector", array_to_vector("features")))
        added = [c for c in scored.columns if c not in df.columns]
        return scored.withColumn("prob", vector_to_array("probability")[AGGRESSIVE]).drop(*added)

    return score


def batch_scorer(make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, batch_size: int = 32) -> Scorer:
    """Any Python model: ``make_predict`` loads it once per worker, batches go through Arrow."""

    def score(df: DataFrame) -> DataFrame:
        predict = predict_batch_udf(
            make_predict, return_type=T.FloatType(), batch_size=batch_size, input_tensor_shapes=[[size]]
        )
        return df.withColumn("prob", predict("features").cast("double"))

    return score


def worst_pairs(windows: DataFrame, scored: DataFrame, key: str = "clip_id") -> DataFrame:
    """Per window the highest pair score and its pair; windows without pairs get 0 and NULL.

    ``scored`` has key, start, i, j, rank, prob; the lower rank wins equal scores.
    """
    rows = windows.select(key, "start").unionByName(
        scored.select(key, "start", "i", "j", "rank", "prob"), allowMissingColumns=True
    )
    order = F.when(F.col("prob").isNotNull(), F.struct("prob", -F.col("rank")))
    return rows.groupBy(key, "start").agg(
        F.coalesce(F.max("prob"), F.lit(0.0)).alias("prob"),
        F.max_by(F.struct("i", "j"), order).alias("pair"),
    )
