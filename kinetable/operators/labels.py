"""Rule-based labels and the pooled binary taxonomy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.dims import (
    AGGRESSIVE,
    EVENT_ACTIONS,
    EVENT_AGGRESSIVE_COUNT,
    EVENT_KEYWORDS,
    INTERACTION_AGGRESSIVE,
    INTERACTION_AGGRESSIVE_IDS,
    INTERACTION_CLASSES,
    INTERACTION_DATASET,
    INTERACTION_NEUTRAL,
    INTERACTION_NEUTRAL_IDS,
    NEUTRAL,
    depth_classes,
)
from kinetable.functions.text import base_name, first_match, last_field, whole_number


def event_label(path: Column) -> Column:
    """Event-camera class index from the whole path, NULL when no keyword occurs."""
    index = {name: i for i, name in enumerate(EVENT_ACTIONS)}
    rules = [(word, index[name]) for word, name in EVENT_KEYWORDS]
    rules += [(name, i) for i, name in enumerate(EVENT_ACTIONS)]
    return first_match(F.lower(path), rules)


def event_label_columns(df: DataFrame, path: str) -> DataFrame:
    """Add label, label_name and aggressive; all NULL when the class is unknown."""
    names = F.array(*[F.lit(n) for n in EVENT_ACTIONS])
    labelled = df.withColumn("label", event_label(F.col(path)))
    return labelled.withColumns(
        {
            "label_name": F.when(F.col("label").isNotNull(), names[F.col("label")]),
            "aggressive": F.col("label") < EVENT_AGGRESSIVE_COUNT,
        }
    )


def filename_label(path: Column) -> Column:
    """Interaction class from a file name: keyword, else trailing integer, else 0."""
    name = F.lower(F.replace(base_name(path), F.lit(".npz"), F.lit("")))
    keyword = first_match(name, [(word, i) for i, word in enumerate(INTERACTION_CLASSES)])
    return F.coalesce(keyword.cast("bigint"), whole_number(last_field(name)), F.lit(0).cast("bigint"))


def clip_label(label: Column, path: Column) -> Column:
    """A stored label wins over the one read from the file name."""
    return F.coalesce(label.cast("bigint"), filename_label(path))


def interaction_flag(path: Column) -> Column:
    """Binary label from an interaction clip name, NULL when unrecognised."""
    name = F.replace(F.lower(base_name(path)), F.lit(".npz"), F.lit(""))
    words = [(w, AGGRESSIVE) for w in INTERACTION_AGGRESSIVE]
    words += [(w, NEUTRAL) for w in INTERACTION_NEUTRAL]
    number = whole_number(last_field(name))
    by_id = F.when(number.isin(INTERACTION_AGGRESSIVE_IDS), AGGRESSIVE).when(
        number.isin(INTERACTION_NEUTRAL_IDS), NEUTRAL
    )
    return F.coalesce(first_match(name, words), by_id)


def binary_label(aggressive: Column, path: Column, dataset: Column) -> Column:
    """Stored flag first; the file name counts only for interaction or unnamed datasets."""
    named = F.coalesce(dataset, F.lit(""))
    by_name = F.when(named.isin(INTERACTION_DATASET, ""), interaction_flag(path))
    return F.coalesce(aggressive.cast("int"), by_name)


def attach_depth_labels(
    clips: DataFrame, action: str = "action", subtle_as_aggressive: bool = False
) -> DataFrame:
    """Left join with the 18-row class table; other actions keep NULL labels."""
    classes = depth_classes(clips.sparkSession)
    flag = F.col("aggressive")
    if subtle_as_aggressive:
        flag = flag | (F.col("tier") == "subtle")
    table = classes.select(
        F.col("action").alias(action), "label", "label_name", flag.alias("aggressive")
    )
    return clips.join(F.broadcast(table), action, "left")


def pooled(
    specs: list[tuple[str, DataFrame]], path: str = "source", flag: str = "aggressive"
) -> DataFrame:
    """Union of tagged clip tables under the binary label; unknown labels are dropped."""
    tagged = [clips.withColumn("dataset", F.lit(name)) for name, clips in specs]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if flag not in union.columns:
        union = union.withColumn(flag, F.lit(None).cast("boolean"))
    label = binary_label(F.col(flag), F.col(path), F.col("dataset"))
    return union.withColumn("binary", label).filter(F.col("binary").isNotNull())
