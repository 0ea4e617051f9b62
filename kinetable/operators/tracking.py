"""Slot tracking of detections.

The per-frame work (best detections, centroids) runs in Spark. The slot decision of a
frame depends on the frame before it, but a frame that fills all slots fixes what follows
up to the names of the slots. A clip is cut at such frames, one a chunk at most; each
segment is scanned alone under names of its own, and the renaming from one segment to the
next is composed from one permutation per segment. A scan sees four numbers per detection,
streams through its segment batch by batch and keeps max_persons centroids as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.joints import array_sum
from kinetable.operators.batches import equal_runs
from kinetable.operators.chunks import earlier, with_chunk
from kinetable.session import materialize

#: The segment of a clip's first frames, which starts with free slots.
OPENING = -1
SEEN = 0.1  # joint confidence above which a joint counts for the remembered centroid (fixed value)


def with_default_confidence(detections: DataFrame) -> DataFrame:
    """Missing joint and box confidences become 1."""
    return detections.withColumns(
        {
            "box_conf": F.coalesce("box_conf", F.lit(1.0)),
            "joints": F.transform(
                "joints",
                lambda j: F.struct(
                    j.x.cast("double").alias("x"),
                    j.y.cast("double").alias("y"),
                    F.coalesce(j.s.cast("double"), F.lit(1.0)).alias("s"),
                ),
            ),
        }
    )


def top_detections(detections: DataFrame, max_persons: int = 2, key: str = "clip_id") -> DataFrame:
    """Most confident detections per frame with their rank; the later one wins ties."""
    order = Window.partitionBy(key, "frame").orderBy(F.col("box_conf").desc(), F.col("det").desc())
    return detections.withColumn("rank", F.row_number().over(order) - 1).filter(
        F.col("rank") < max_persons
    )


def detection_centroids(detections: DataFrame, key: str = "clip_id") -> DataFrame:
    """(cx, cy) over all joints for matching, (vx, vy) over confident joints to remember."""
    seen = F.filter("joints", lambda j: j.s > SEEN)
    sure = detections.withColumn("_sure", F.when(F.size(seen) > 0, seen).otherwise(F.col("joints")))

    def mean(points: str, axis: str) -> Column:
        return array_sum(F.col(f"{points}.{axis}")) / F.size(points)

    return sure.select(
        key,
        "frame",
        "rank",
        mean("joints", "x").alias("cx"),
        mean("joints", "y").alias("cy"),
        mean("_sure", "x").alias("vx"),
        mean("_sure", "y").alias("vy"),
    )


def match_slots(points: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, bool]:
    """Slot of each detection: closest free pairs first, newcomers take free slots in order.

    ``points`` is (n, 2), ``slots`` is (m, 2) with NaN for slots never used; n <= m. Also
    whether a detection was as close to a second slot, so that the slots' order decided.
    """
    tied = False
    gaps = np.sqrt(((points[:, None, :] - slots[None, :, :]) ** 2).sum(axis=2))
    given = np.full(len(points), -1)
    while True:
        best = np.nanargmin(gaps) if not np.isnan(gaps).all() else -1
        if best < 0:
            break
        det, slot = divmod(int(best), gaps.shape[1])
        tied |= int((gaps[det] == gaps[det, slot]).sum()) > 1
        given[det] = slot
        gaps[det, :] = np.nan
        gaps[:, slot] = np.nan
    unused = [s for s in range(len(slots)) if s not in set(given.tolist())]
    waiting = np.flatnonzero(given < 0)
    given[waiting] = unused[: len(waiting)]
    return given, tied


def advance(points: np.ndarray, remembered: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, bool]:
    """Slots of one frame's detections (in rank order), and whether a tie decided; updates ``slots`` in place."""
    given, tied = match_slots(points, slots)
    slots[given] = remembered
    return given, tied


def _segments(centroids: DataFrame, max_persons: int, key: str) -> DataFrame:
    """Adds ``segment``, the frame at which a row's segment starts, and ``closes``.

    The first full frame of a chunk starts a segment; its rows also close the segment before.
    """
    full = F.min(F.when(F.col("rank") == max_persons - 1, F.col("frame")))
    chunked = with_chunk(centroids)
    cuts = chunked.groupBy(key, "chunk").agg(full.alias("_cut"))
    before = F.last("_cut", ignorenulls=True).over(earlier(key))
    cuts = cuts.select(key, "chunk", "_cut", F.coalesce(before, F.lit(OPENING)).alias("_before"))
    starts = F.col("frame") >= F.col("_cut")
    own = F.when(starts, F.col("_cut")).otherwise(F.col("_before"))
    places = [F.struct(own.alias("segment"), F.lit(False).alias("closes"))]
    twice = F.struct(F.col("_before").alias("segment"), F.lit(True).alias("closes"))
    spread = F.when(F.col("frame") == F.col("_cut"), F.array(*places, twice)).otherwise(F.array(*places))
    rows = chunked.join(cuts, [key, "chunk"]).withColumn("_place", F.explode(spread))
    return rows.select(*centroids.columns, "_place.segment", "_place.closes")


def _scan_segments(rows: DataFrame, max_persons: int, key: str) -> DataFrame:
    """(key, segment, closes, frame, rank, person, tied): slots under each segment's own names.

    The opening segment starts with free slots, any other names the slots by the ranks of its
    first frame.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, slots = None, None
        held: pd.DataFrame | None = None

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal current, slots
            names, segments = rows[key].to_numpy(), rows["segment"].to_numpy()
            points, remembered = rows[["cx", "cy"]].to_numpy(), rows[["vx", "vy"]].to_numpy()
            given, ties = np.empty(len(rows), dtype=np.int32), np.zeros(len(rows), dtype=bool)
            for low, high in equal_runs(names, segments, rows["frame"].to_numpy()):
                if (names[low], segments[low]) != current:
                    current, slots = (names[low], segments[low]), np.full((max_persons, 2), np.nan)
                given[low:high], ties[low:high] = advance(points[low:high], remembered[low:high], slots)
            return rows[[key, "segment", "closes", "frame", "rank"]].assign(person=given, tied=ties)

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows.empty:
                continue
            final = rows.iloc[-1]
            unfinished = (rows[key] == final[key]) & (rows["segment"] == final["segment"]) & (rows["frame"] == final["frame"])
            held = rows[unfinished]
            if not unfinished.all():
                yield run(rows[~unfinished])
        if held is not None and len(held):
            yield run(held)

    ordered = rows.repartition(key, "segment").sortWithinPartitions(key, "segment", "frame", "rank")
    kind = rows.schema[key].dataType.simpleString()
    return ordered.mapInPandas(scan, f"{key} {kind}, segment int, closes boolean, frame int, rank int, person int, tied boolean")


def _names(scanned: DataFrame, max_persons: int, key: str) -> DataFrame:
    """(key, segment, names): the clip's name of each slot of a segment, composed along the clip."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "person")))
    steps = scanned.filter("closes").groupBy(key, "segment", "frame").agg(pairs.alias("pairs"))
    steps = steps.select(key, "segment", F.col("frame").alias("next"), F.col("pairs.person").alias("person"))

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("segment")
        names, found = list(range(max_persons)), []
        for person in rows["person"]:
            names = [names[slot] for slot in person]
            found.append(names)
        return pd.DataFrame({key: rows[key], "segment": rows["next"], "names": found})

    kind = scanned.schema[key].dataType.simpleString()
    # A row per segment: at most one a chunk of the clip.
    return steps.groupBy(key).applyInPandas(compose, f"{key} {kind}, segment int, names array<int>")


def assign_slots(centroids: DataFrame, max_persons: int = 2, key: str = "clip_id") -> DataFrame:
    """(key, frame, rank, person) for every detection.

    Between two slots at exactly the same distance the order of the names decides, which a
    segment on its own does not know: clips with such a tie are scanned again from their start.
    """
    found = ["frame", "rank", "person"]
    scanned = materialize(_scan_segments(_segments(centroids, max_persons, key), max_persons, key), "slot-segments")
    tied = materialize(scanned.filter((F.col("segment") > OPENING) & F.col("tied")).select(key).distinct(), "slot-ties")
    split = scanned.filter(~F.col("closes")).join(tied, key, "left_anti")
    named = split.join(_names(scanned, max_persons, key), [key, "segment"], "left")
    person = F.coalesce(F.element_at("names", F.col("person") + 1), F.col("person"))
    whole = centroids.join(tied, key, "left_semi").withColumns({"segment": F.lit(OPENING), "closes": F.lit(False)})
    again = _scan_segments(whole, max_persons, key)
    return named.withColumn("person", person).select(key, *found).unionByName(again.select(key, *found))


def track(detections: DataFrame, max_persons: int = 2, key: str = "clip_id") -> DataFrame:
    """Detections -> poses with stable person slots."""
    best = top_detections(with_default_confidence(detections), max_persons, key)
    slots = assign_slots(detection_centroids(best, key), max_persons, key)
    return best.join(slots, [key, "frame", "rank"]).select(key, "frame", "person", "joints")
