"""Skeleton normalisation, graph neighbourhoods and fixed-size features of clips and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.dims import NUM_JOINTS, skeleton_edges
from kinetable.functions.joints import array_sum, array_sum_square, visible
from kinetable.operators.chunks import attach_by_key
from kinetable.operators.windows import assign_windows, pad_or_truncate

EPSILON = 1e-6  # added to the pooled deviation before dividing (fixed value)
CHANNELS = ("x", "y", "s")


# --- normalisation -----------------------------------------------------------------------


def spread(n: Column, sx: Column, sy: Column, sq: Column) -> Column:
    """One deviation over x and y together, around their common mean, from sums."""
    count = n * 2.0
    mean = (sx + sy) / count
    return F.sqrt(F.greatest(sq / count - mean * mean, F.lit(0.0)))


def clip_norms(poses: DataFrame, key: str = "clip_id") -> DataFrame:
    """Per clip the mean of the visible joints and their pooled deviation."""
    shown = poses.select(key, visible(F.col("joints")).alias("_seen"))
    rows = shown.select(
        key,
        F.size("_seen").alias("n"),
        array_sum(F.col("_seen.x")).alias("sx"),
        array_sum(F.col("_seen.y")).alias("sy"),
        (array_sum_square(F.col("_seen.x")) + array_sum_square(F.col("_seen.y"))).alias("sq"),
    )
    sums = rows.groupBy(key).agg(
        F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sq")]
    )
    return sums.select(
        key,
        "rows",
        "n",
        F.when(F.col("n") > 0, F.col("sx") / F.col("n")).alias("mx"),
        F.when(F.col("n") > 0, F.col("sy") / F.col("n")).alias("my"),
        F.when(
            F.col("n") > 0, spread(F.col("n"), F.col("sx"), F.col("sy"), F.col("sq")) + EPSILON
        ).alias("dev"),
    )


def normalize_joints(joints: Column, mx: Column, my: Column, dev: Column) -> Column:
    return F.transform(
        joints,
        lambda j: F.struct(
            F.when(j.s > 0, (j.x - mx) / dev).otherwise(F.lit(0.0)).alias("x"),
            F.when(j.s > 0, (j.y - my) / dev).otherwise(F.lit(0.0)).alias("y"),
            j.s.cast("double").alias("s"),
        ),
    )


def normalize_clips(poses: DataFrame, key: str = "clip_id") -> DataFrame:
    """Centre and scale every clip by its visible joints; absent joints become 0.

    A clip without visible joints is returned as it is.
    """
    normed = attach_by_key(poses, clip_norms(poses, key), key, "rows", ["frame", "person"])
    plain = F.transform(
        "joints",
        lambda j: F.struct(
            j.x.cast("double").alias("x"), j.y.cast("double").alias("y"), j.s.cast("double").alias("s")
        ),
    )
    joints = F.when(
        F.col("n") > 0, normalize_joints(F.col("joints"), F.col("mx"), F.col("my"), F.col("dev"))
    ).otherwise(plain)
    return normed.withColumn("joints", joints).select(*poses.columns)


def clip_tensors(
    poses: DataFrame,
    clips: DataFrame,
    target: int = 64,
    max_persons: int = 2,
    normalize: bool = False,
    key: str = "clip_id",
) -> DataFrame:
    """One flat ARRAY<FLOAT> per clip, laid out (channel, t, joint, person).

    The clip is normalized over all its frames, then cut or edge-padded to ``target``;
    an array therefore has 3 * target * 17 * max_persons numbers.
    """
    rows = poses.filter(F.col("person") < max_persons)
    rows = normalize_clips(rows, key) if normalize else rows
    cut = pad_or_truncate(rows, clips, target, key)
    cells = cut.groupBy(key).agg(
        F.map_from_entries(
            F.collect_list(F.struct((F.col("t") * max_persons + F.col("person")).alias("k"), "joints"))
        ).alias("cells")
    )

    def channel(name: str) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(target - 1)),
                lambda t: F.flatten(
                    F.transform(
                        F.sequence(F.lit(0), F.lit(NUM_JOINTS - 1)),
                        lambda v: F.transform(
                            F.sequence(F.lit(0), F.lit(max_persons - 1)),
                            lambda m: F.coalesce(
                                F.col("cells")[t * max_persons + m][v][name].cast("float"),
                                F.lit(0.0).cast("float"),
                            ),
                        ),
                    )
                ),
            )
        )

    return cells.select(key, F.concat(*[channel(c) for c in CHANNELS]).alias("tensor"))


# --- graph and channels --------------------------------------------------------------------


def neighbour_sums(joints: Column, strategy: str = "spatial") -> Column:
    """Weighted sums over skeleton neighbours: array[partition][joint] of (x, y, s).

    The graph is fixed, so the sums are plain column arithmetic inside the row; the
    equivalent edge join would shuffle seventeen rows per skeleton.
    """
    edges = skeleton_edges(strategy)
    parts = sorted({k for k, *_ in edges})

    def gathered(part: int, joint: int, channel: str) -> Column:
        value = F.lit(0.0)
        for k, src, dst, weight in edges:
            if k == part and dst == joint:
                value = value + joints[src][channel].cast("double") * weight
        return value

    return F.array(
        *[
            F.array(
                *[
                    F.struct(*[gathered(k, w, c).alias(c) for c in CHANNELS])
                    for w in range(NUM_JOINTS)
                ]
            )
            for k in parts
        ]
    )


def channel_stats(poses: DataFrame, max_persons: int = 2) -> DataFrame:
    """Mean and deviation per (person, joint, channel) over all rows."""
    rows = poses.filter(F.col("person") < max_persons).select(
        "person", F.posexplode("joints").alias("joint", "p")
    )
    return rows.groupBy("person", "joint").agg(
        *[F.avg(f"p.{c}").alias(f"mean_{c}") for c in CHANNELS],
        *[F.stddev_pop(f"p.{c}").alias(f"dev_{c}") for c in CHANNELS],
    )


def standardize_channels(poses: DataFrame, max_persons: int = 2, eps: float = 1e-5) -> DataFrame:
    """Per-(channel, joint, person) standardisation.

    The statistics have max_persons rows of 17 entries, which bounds the broadcast.
    """
    stats = (
        channel_stats(poses, max_persons)
        .groupBy("person")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("joint", *[f"mean_{c}" for c in CHANNELS], *[f"dev_{c}" for c in CHANNELS])
                )
            ).alias("stats")
        )
    )

    def scaled(joint: Column, stat: Column) -> Column:
        return F.struct(
            *[
                ((joint[c] - stat[f"mean_{c}"]) / F.sqrt(stat[f"dev_{c}"] * stat[f"dev_{c}"] + eps)).alias(c)
                for c in CHANNELS
            ]
        )

    kept = poses.filter(F.col("person") < max_persons)
    return (
        kept.join(F.broadcast(stats), "person")
        .withColumn("joints", F.zip_with("joints", "stats", scaled))
        .select(*poses.columns)
    )


# --- fixed-size features from one aggregation -------------------------------------------------


PLAIN = ("n", "sx", "sy", "sq")


def _terms(poses: DataFrame, keep: list[str], normalize: bool, level: str) -> DataFrame:
    """Skeletons reduced to the numbers whose sums give every feature.

    n, sx, sy, sq: visible joints (the normalisation). k_*, x_*, xx_*, ...: sums that count
    once per padded time step; one set per joint (level ``joint``) or one over all joints
    (level ``pooled``). With normalisation only visible joints count, otherwise all of them.
    """
    rows = poses.withColumn("_seen", visible(F.col("joints")))
    joints = F.col("joints")
    terms = {
        "n": F.size("_seen"),
        "sx": array_sum(F.col("_seen.x")),
        "sy": array_sum(F.col("_seen.y")),
        "sq": array_sum_square(F.col("_seen.x")) + array_sum_square(F.col("_seen.y")),
    }
    if level == "pooled":
        used = "_seen" if normalize else "joints"
        terms["k_all"] = F.size(used)
        for c in CHANNELS:
            values = F.col(f"joints.{c}" if c == "s" else f"{used}.{c}")
            terms[f"{c}_all"] = array_sum(values)
            terms[f"{c}{c}_all"] = array_sum_square(values)
    else:
        for j in range(NUM_JOINTS):
            joint = joints[j]
            count = F.when(joint["s"] > 0, 1.0).otherwise(0.0) if normalize else F.lit(1.0)
            terms[f"k_{j}"] = count
            for c in CHANNELS:
                value = joint[c].cast("double") if c == "s" else count * joint[c].cast("double")
                terms[f"{c}_{j}"] = value
                terms[f"{c}{c}_{j}"] = value * joint[c].cast("double")
    return rows.select(*keep, *[e.alias(n) for n, e in terms.items()])


def _summed(df: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    names = [c for c in df.columns if c.split("_")[0] in (*PLAIN, "k", "x", "xx", "y", "yy", "s", "ss") and c not in group]
    if weight is not None:
        df = df.withColumn("weight", weight)

    def term(name: str) -> Column:
        return F.col(name) if weight is None or name in PLAIN else F.col(name) * F.col("weight")

    return df.groupBy(*group).agg(*[F.sum(term(n)).alias(n) for n in names])


def _features(
    sums: DataFrame, group: list[str], normalize: bool, steps: int, persons: int, level: str, zero_fill: bool = True
) -> DataFrame:
    """``joint``: mean and deviation per channel and joint (102 numbers); ``pooled``: per channel (6)."""
    seen = F.nullif(F.col("n"), F.lit(0))
    prepared = sums.select(
        *sums.columns,
        (F.col("sx") / seen).alias("mid_x"),
        (F.col("sy") / seen).alias("mid_y"),
        (spread(seen, F.col("sx"), F.col("sy"), F.col("sq")) + EPSILON).alias("dev"),
    )
    slots = ["all"] if level == "pooled" else list(range(NUM_JOINTS))
    count = F.lit(float(steps * persons * (NUM_JOINTS if level == "pooled" else 1))) if zero_fill else F.nullif(F.col("k_there"), F.lit(0.0))
    values: list[Column] = []
    for c in CHANNELS:
        for slot in slots:
            first, second = F.col(f"{c}_{slot}"), F.col(f"{c}{c}_{slot}")
            if normalize and c != "s":
                mid, dev, used = F.col(f"mid_{c}"), F.col("dev"), F.col(f"k_{slot}")
                second = (second - mid * first * 2.0 + mid * mid * used) / (dev * dev)
                first = (first - mid * used) / dev
                first, second = F.coalesce(first, F.lit(0.0)), F.coalesce(second, F.lit(0.0))
            mean = first / count
            values += [mean, F.sqrt(F.greatest(second / count - mean * mean, F.lit(0.0)))]
    return prepared.select(*group, F.array(*values).alias("features"))


def clip_features(
    poses: DataFrame,
    clips: DataFrame,
    target: int = 64,
    max_persons: int = 2,
    normalize: bool = True,
    level: str = "joint",
    key: str = "clip_id",
    zero_fill: bool = True,
) -> DataFrame:
    """Features of each clip as if cut or edge-padded to ``target`` frames: one aggregation.

    People who are not in a frame count as zeros, as in a tensor; without ``zero_fill`` the
    means are those of the people who are there.
    """
    rows = _terms(
        poses.filter(F.col("person") < max_persons), [key, "frame", "person"], normalize, level
    )
    if not zero_fill:
        rows = rows.withColumn("k_there", F.lit(float(NUM_JOINTS if level == "pooled" else 1)))
    lengths = clips.select(key, F.col("num_frames").alias("_frames"), F.col("num_frames").alias("_w"))
    sized = attach_by_key(rows, lengths, key, "_w", ["frame", "person"])
    last = (F.col("frame") == F.col("_frames") - 1) & (F.col("_frames") < target)
    weight = (
        F.when(F.col("frame") >= target, 0.0)
        .when(last, (F.lit(target) - F.col("frame")).cast("double"))
        .otherwise(1.0)
    )
    return _features(_summed(sized, [key], weight), [key], normalize, target, max_persons, level, zero_fill)


def _window_sums(poses, clips, window, stride, normalize, level, key) -> DataFrame:
    """Sums per (clip, window, person); windows of short clips are edge-padded by weight."""
    rows = _terms(poses, [key, "frame", "person"], normalize, level)
    placed = assign_windows(rows, clips, window, stride, key)
    last = (F.col("window_frames") < window) & (F.col("frame") == F.col("window_frames") - 1)
    weight = F.when(last, (F.lit(window) - F.col("frame")).cast("double")).otherwise(1.0)
    return _summed(placed, [key, "start", "person"], weight)


def window_features(
    poses: DataFrame,
    clips: DataFrame,
    window: int = 64,
    stride: int = 16,
    max_persons: int = 2,
    normalize: bool = True,
    level: str = "joint",
    key: str = "clip_id",
) -> DataFrame:
    """Features of every window over all people."""
    rows = poses.filter(F.col("person") < max_persons)
    sums = _window_sums(rows, clips, window, stride, normalize, level, key).drop("person")
    group = [key, "start"]
    return _features(_summed(sums, group), group, normalize, window, max_persons, level)


def pair_features(
    poses: DataFrame,
    clips: DataFrame,
    pairs: DataFrame,
    window: int = 64,
    stride: int = 16,
    normalize: bool = True,
    level: str = "joint",
    key: str = "clip_id",
) -> DataFrame:
    """Features of the two people of each candidate pair.

    Sums are taken once per person and window; a pair adds the sums of its two members,
    so no skeleton is repeated per pair.
    """
    sums = _window_sums(poses, clips, window, stride, normalize, level, key)
    members = pairs.select(key, "start", "i", "j", F.explode(F.array("i", "j")).alias("person"))
    joined = members.join(sums, [key, "start", "person"]).drop("person")
    group = [key, "start", "i", "j"]
    return _features(_summed(joined, group), group, normalize, window, 2, level)
