"""Per-person statistics, nearest neighbours and pair search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.joints import array_sum, distance, median_of, visible
from kinetable.operators.chunks import frame_spine
from kinetable.operators.windows import assign_windows

# Largest group of people compared inside one row; larger slot counts go through blocks.
ROW_SLOTS = 64
MIN_HEIGHT_JOINTS = 5  # visible joints a frame needs to count for the height gate (fixed value)


def with_stats(poses: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus visible count, coordinate sums, vertical extent and centroid of ``joints``."""
    shown_joints = poses.select(*keep, visible(F.col("joints")).alias("_seen"))
    stats = shown_joints.select(
        *keep,
        F.size("_seen").alias("n"),
        array_sum(F.col("_seen.x")).alias("sx"),
        array_sum(F.col("_seen.y")).alias("sy"),
        F.array_min("_seen.y").cast("double").alias("low"),
        F.array_max("_seen.y").cast("double").alias("high"),
    )
    shown = F.col("n") > 0
    return stats.withColumns(
        {
            "cx": F.when(shown, F.col("sx") / F.col("n")),
            "cy": F.when(shown, F.col("sy") / F.col("n")),
        }
    )


def person_stats(poses: DataFrame, key: str = "clip_id") -> DataFrame:
    """Statistics of every person-frame with at least one visible joint."""
    return with_stats(poses, [key, "frame", "person"]).filter(F.col("n") > 0)


def checked_slot(slots: int) -> Column:
    """The person slot, failing the job when it is outside the declared number of slots."""
    return F.when(
        F.col("person").isNull() | (F.col("person") < slots), F.col("person")
    ).otherwise(F.raise_error(F.lit(f"person slot outside the declared {slots}")).cast("int"))


def neighbours(
    people: DataFrame, group: list[str], slots: int, extra: str | None = None
) -> DataFrame:
    """Nearest other person of every person, within each group.

    ``people`` has the group columns, person, cx, cy, h (NULL person marks a group that
    must appear even if empty). A person occurs once per group and has a slot below
    ``slots``, so a group holds at most ``slots`` people; that is checked, not assumed.
    Up to ROW_SLOTS a group is one row and the search happens inside it. Above, people
    are packed into blocks of ROW_SLOTS and each block is compared with one block at a
    time, keeping only the best per person.

    Result: group columns, person, near, d, scale (median h), n, and the ``extra`` value of
    both as a_extra and b_extra. ``near`` is NULL for someone alone.
    """
    extra_value = (F.col(extra) if extra else F.lit(None)).cast("double")
    entry = F.struct(
        checked_slot(slots).alias("person"), F.col("cx"), F.col("cy"), F.col("h"),
        extra_value.alias("extra"),
    )
    entry = F.when(F.col("person").isNotNull(), entry)
    if slots <= ROW_SLOTS:
        packed = people.groupBy(*group).agg(F.collect_list(entry).alias("people"))
        scaled = packed.select(
            *group,
            "people",
            F.size("people").alias("n"),
            median_of(F.transform("people", lambda p: p.h)).alias("scale"),
        )
        single = scaled.select(*group, "n", "scale", "people", F.explode_outer("people").alias("a"))
        return _unpack(
            single.withColumn("best", _best(F.col("people"), F.col("a"))), group
        )

    blocked = people.withColumn("block", F.expr(f"cast(person as bigint) div {ROW_SLOTS}"))
    blocks = blocked.groupBy(*group, "block").agg(F.collect_list(entry).alias("people"))
    scales = people.groupBy(*group).agg(
        F.expr("percentile(h, 0.5D)").alias("scale"), F.count("person").cast("int").alias("n")
    )
    others = blocks.select(*group, F.col("people").alias("others"))
    tiles = blocks.join(others, group).select(
        *group, "others", F.explode("people").alias("a")
    )
    best = (
        tiles.withColumn("best", _best(F.col("others"), F.col("a")))
        .groupBy(*group, F.col("a.person").alias("_person"))
        .agg(F.min("best").alias("best"), F.first("a").alias("a"))
        .drop("_person")
    )
    return _unpack(scales.join(best, group, "left"), group)


def _best(others: Column, a: Column) -> Column:
    """Closest entry of ``others`` that is not ``a``; the lowest slot wins ties."""
    return F.array_min(
        F.transform(
            F.filter(others, lambda b: b.person != a["person"]),
            lambda b: F.struct(
                distance(a["cx"], a["cy"], b.cx, b.cy).alias("d"),
                b.person.alias("person"),
                b.extra.alias("extra"),
            ),
        )
    )


def _unpack(df: DataFrame, group: list[str]) -> DataFrame:
    return df.select(
        *group,
        F.col("a.person").alias("person"),
        F.col("best.person").alias("near"),
        F.col("best.d").alias("d"),
        "scale",
        "n",
        F.col("a.extra").alias("a_extra"),
        F.col("best.extra").alias("b_extra"),
    )


def crowd_pressure(
    stats: DataFrame, clips: DataFrame, key: str = "clip_id", max_persons: int = 16
) -> DataFrame:
    """Mean closeness of visible people to their nearest neighbour, per frame; 0 below two people.

    ``stats`` is the result of ``person_stats``.
    """
    people = stats.select(
        key, "frame", "person", "cx", "cy",
        F.greatest(F.col("high") - F.col("low"), F.lit(1.0)).alias("h"),
    )
    empty = frame_spine(clips, key)
    with_spine = people.unionByName(empty, allowMissingColumns=True)
    near = neighbours(with_spine, [key, "frame"], max_persons)
    closeness = F.col("scale") / (F.col("scale") + F.col("d"))
    return near.groupBy(key, "frame").agg(
        F.coalesce(F.avg(closeness), F.lit(0.0)).alias("pressure")
    )


def window_people(
    stats: DataFrame,
    clips: DataFrame,
    window: int = 64,
    stride: int = 16,
    min_visibility: float = 0.3,
    key: str = "clip_id",
) -> DataFrame:
    """People present in each window, over all their visible points of the window.

    A person is present when visible in at least ``min_visibility`` of the window's frames.
    ``tall`` is the median height over frames with enough joints (NULL when there is none).
    ``stats`` is the result of ``person_stats``.
    """
    height = F.when(F.col("n") >= MIN_HEIGHT_JOINTS, F.col("high") - F.col("low"))
    slim = stats.withColumn("height", height)
    placed = assign_windows(slim, clips, window, stride, key)
    return (
        placed.groupBy(key, "start", "person")
        .agg(
            F.count("*").alias("frames"),
            F.first("window_frames").alias("window_frames"),
            (F.sum("sx") / F.sum("n")).alias("cx"),
            (F.sum("sy") / F.sum("n")).alias("cy"),
            F.greatest(F.max("high") - F.min("low"), F.lit(1.0)).alias("h"),
            F.expr("percentile(height, 0.5D)").alias("tall"),
        )
        .filter(F.col("frames") / F.col("window_frames") >= min_visibility)
        .drop("frames", "window_frames")
    )


def candidate_pairs(
    stats: DataFrame,
    clips: DataFrame,
    window: int = 64,
    stride: int = 16,
    max_pairs: int = 16,
    distance_scale: float = 2.5,
    min_visibility: float = 0.3,
    min_pair_height: float = 0.0,
    key: str = "clip_id",
    max_persons: int = 16,
) -> DataFrame:
    """Interacting pairs per window: (key, start, i, j, d, rank), closest first.

    Each present person proposes the nearest other one when within ``distance_scale``
    median sizes. The ``max_pairs`` closest are kept and then pass the height gate.
    ``stats`` is the result of ``person_stats``.
    """
    present = window_people(stats, clips, window, stride, min_visibility, key)
    near = neighbours(present, [key, "start"], max_persons, extra="tall")
    proposed = near.filter(F.col("d") <= F.lit(distance_scale) * F.col("scale")).select(
        key,
        "start",
        F.least("person", "near").alias("i"),
        F.greatest("person", "near").alias("j"),
        "d",
        "person",
        F.least(
            F.coalesce("a_extra", F.lit(-1.0)), F.coalesce("b_extra", F.lit(-1.0))
        ).alias("shorter"),
    )
    pairs = proposed.groupBy(key, "start", "i", "j").agg(
        F.min("d").alias("d"), F.min("person").alias("first"), F.first("shorter").alias("shorter")
    )
    order = Window.partitionBy(key, "start").orderBy("d", "first")
    kept = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_pairs)
    if min_pair_height > 0:
        kept = kept.filter(F.col("shorter") >= min_pair_height)
    return kept.select(key, "start", "i", "j", "d", "rank")
