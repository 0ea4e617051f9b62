import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetable import dims
from kinetable.functions.numeric import argmax, softmax, temporal_iou
from kinetable.operators import (
    chunks,
    events,
    features,
    incidents,
    ingest,
    labels,
    metrics,
    people,
    scoring,
    signals,
    splits,
    tracking,
    windows,
)
from tests.helpers import (
    clips_frame,
    np_average,
    sql_incidents,
    sql_motion,
    sql_pairs,
    sql_pressure,
    sql_spikes,
    np_starts,
    poses_frame,
    random_scene,
)

relaxed = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def close(a, b, tol=1e-9):
    assert np.allclose(np.asarray(a, float), np.asarray(b, float), atol=tol)


# --- events ------------------------------------------------------------------------------


def event_rows(spark, rows, key="segment"):
    return spark.createDataFrame(rows, f"{key} string, t_us double, x double, y double, p double")


def test_polarity_and_clipping(spark):
    rows = [("a", 0.0, 10.0, 10.0, 1.0), ("a", 1.0, 10.0, 10.0, -1.0), ("a", 2.0, 10.0, 10.0, 0.0),
            ("b", 5.0, 9999.0, -5.0, 1.0), ("b", 33005.0, -0.9, 3.9, 1.0)]
    cells = {tuple(r) for r in events.accumulate(event_rows(spark, rows)).collect()}
    assert cells == {("a", 0, 0, 10, 10, 1), ("a", 0, 1, 10, 10, 2), ("b", 0, 0, 0, 345, 1), ("b", 1, 0, 3, 0, 1)}


def test_accumulate_keeps_every_event_with_hot_key(spark, tiny_chunks):
    rng = np.random.default_rng(1)
    rows = [
        ("hot" if rng.random() < 0.7 else f"s{rng.integers(6)}", float(t), float(rng.integers(346)),
         float(rng.integers(260)), float(rng.choice([-1, 1])))
        for t in np.sort(rng.integers(0, 100_000, 1000))
    ]
    cells = events.accumulate(event_rows(spark, rows))
    assert cells.agg(F.sum("n")).first()[0] == 1000
    assert cells.agg(F.max("frame")).first()[0] <= 3
    firsts = {}
    for s, t, *_ in rows:
        firsts[s] = min(firsts.get(s, t), t)
    want = {(s, int((t - firsts[s]) // 33000)) for s, t, *_ in rows}
    assert {tuple(r) for r in cells.select("segment", "frame").distinct().collect()} == want


def test_render_scale_is_p99_and_truncates(spark):
    counts = [1] * 50 + [3] * 40 + [9] * 10
    rows = [("a", i, 0 if i % 2 else 1, i, 0, n) for i, n in enumerate(counts)]
    cells = spark.createDataFrame(rows, "segment string, frame int, channel int, y int, x int, n bigint")
    scale = max(np.percentile(counts, 99), 1.0)
    assert events.render_scale(cells).first()["scale"] == pytest.approx(scale)
    pixel = {r["y"]: (r["r"], r["b"]) for r in events.render(cells).collect()}
    for i, n in enumerate(counts):
        level = int(min(n / scale * 255.0, 255.0))
        assert pixel[i] == ((level, 0) if i % 2 else (0, level))


def test_empty_events(spark):
    cells = events.accumulate(event_rows(spark, []))
    assert cells.count() == 0 and events.render(cells).count() == 0


def test_field_aliases(spark):
    named = spark.createDataFrame([("a", 1, 2, 3, 1)], "segment string, timestamp int, x int, y int, pol int")
    assert tuple(events.resolve_fields(named).first()) == ("a", 1.0, 2.0, 3.0, 1.0)
    with pytest.raises(ValueError, match="'p'"):
        events.resolve_fields(named.drop("pol"))


# --- labels -------------------------------------------------------------------------------------


def test_event_keywords(spark):
    names = ["clip_punching_001", "S1_slap_02", "hair_grab_07", "totally_unknown_action", "A/Handshake/x"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    found = [r["label"] for r in df.select("path", labels.event_label(F.col("path")).alias("label")).collect()]
    assert found == [1, 0, 4, None, 8]


def test_binary_from_names(spark):
    rows = [("seq_kick_01", None, ""), ("0_11_4", None, "ut_interaction"), ("1_2_3.npz", None, ""),
            ("seq_99", None, ""), ("mystery", None, ""), ("seq_kick_01", False, ""), ("seq_kick", None, "other")]
    df = spark.createDataFrame(rows, "path string, aggressive boolean, dataset string")
    label = labels.binary_label(F.col("aggressive"), F.col("path"), F.col("dataset"))
    assert [r[0] for r in df.select(label).collect()] == [1, 1, 0, None, None, 0, None]


def test_file_labels(spark):
    df = spark.createDataFrame([("d/a_hug_1.npz", None), ("clip_03.npz", None), ("x.npz", None), ("x_kick", 7)],
                               "path string, label int")
    found = df.select(labels.clip_label(F.col("label"), F.col("path"))).collect()
    assert [r[0] for r in found] == [1, 3, 0, 7]


def test_depth_classes(spark):
    rows = dims.depth_classes(spark).collect()
    assert [r["label"] for r in rows] == list(range(18))
    assert [r["aggressive"] for r in rows] == [True] * 8 + [False] * 10
    clips = spark.createDataFrame([(50,), (54,), (1,)], "action int")
    got = {r["action"]: r["aggressive"] for r in labels.attach_depth_labels(clips).collect()}
    assert got == {50: True, 54: False, 1: None}
    wide = labels.attach_depth_labels(clips, subtle_as_aggressive=True)
    assert {r["action"]: r["aggressive"] for r in wide.collect()}[54] is True


def test_pooled_drops_unknown(spark):
    a = spark.createDataFrame([("x_kick_1.npz", None), ("mystery.npz", None)], "source string, aggressive boolean")
    b = spark.createDataFrame([("q.npz", True), ("r.npz", False)], "source string, aggressive boolean")
    pooled = labels.pooled([("ut_interaction", a), ("other", b)])
    assert {(r["dataset"], r["binary"]) for r in pooled.collect()} == {("ut_interaction", 1), ("other", 1), ("other", 0)}
    bare = labels.pooled([("ut_interaction", a.drop("aggressive"))])
    assert bare.count() == 1


# --- splits --------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 7, 100])
def test_split_sizes_and_repeatability(spark, n):
    items = spark.createDataFrame([(f"c{i}",) for i in range(n)], "clip_id string")
    one = {r["clip_id"]: r["split"] for r in splits.assign_split(items).collect()}
    two = {r["clip_id"]: r["split"] for r in splits.assign_split(items.repartition(3)).collect()}
    assert one == two and len(one) == n
    sizes = list(one.values())
    assert sizes.count("test") == int(n * 0.15) and sizes.count("val") == int(n * 0.15)
    held = [r["split"] for r in splits.assign_holdout(items).collect()]
    assert held.count("val") == (max(1, int(n * 0.2)) if n > 1 else 0) and len(held) == (n if n > 1 else 0)
    if n == 100:
        other = {r["clip_id"]: r["split"] for r in splits.assign_split(items, seed=7).collect()}
        assert other != one


# --- windows ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("window,stride", [(8, 4), (8, 3), (64, 16), (5, 7)])
def test_window_starts_and_members(spark, tiny_chunks, window, stride):
    lengths = {f"c{t}": t for t in (0, 1, 5, 8, 9, 31, 64, 70, 200)}
    clips = clips_frame(spark, lengths)
    found = {}
    for r in windows.window_starts(clips, window, stride).collect():
        found.setdefault(r["clip_id"], []).append(r["start"])
    assert {k: sorted(v) for k, v in found.items()} == {k: np_starts(t, window, stride) for k, t in lengths.items()}
    frames = chunks.frame_spine(clips)
    members = {(r["clip_id"], r["start"], r["frame"]) for r in windows.assign_windows(frames, clips, window, stride).collect()}
    want = {
        (c, s, f) for c, t in lengths.items() for s in np_starts(t, window, stride) for f in range(s, min(s + window, t))
    }
    assert members == want


def test_pad_or_truncate(spark):
    scene = random_scene(3, 12, 2)
    poses = poses_frame(spark, {"a": scene}, skip_hidden=False)
    clips = clips_frame(spark, {"a": 12})
    for target in (5, 12, 20):
        rows = {(r["t"], r["person"]): r["frame"] for r in windows.pad_or_truncate(poses, clips, target).collect()}
        assert rows == {(t, m): min(t, 11) for t in range(target) for m in range(2)}


# --- people ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scenes():
    return {"hot": random_scene(5, 90, 5), "b": random_scene(6, 20, 3), "c": random_scene(7, 7, 4)}


@pytest.fixture(scope="module")
def scene_tables(spark, scenes):
    poses = poses_frame(spark, scenes).cache()
    return poses, clips_frame(spark, {k: len(v[0]) for k, v in scenes.items()})


@pytest.mark.parametrize("slots", [16, 100])
def test_crowd_pressure(spark, tiny_chunks, scenes, scene_tables, slots, monkeypatch):
    if slots > people.ROW_SLOTS:
        monkeypatch.setattr(people, "ROW_SLOTS", 2)  # force blocks of two people
    poses, clips = scene_tables
    rows = people.crowd_pressure(people.person_stats(poses), clips, max_persons=slots).collect()
    got = {(r["clip_id"], r["frame"]): r["pressure"] for r in rows}
    want = {(c, t): v for c, s in scenes.items() for t, v in enumerate(sql_pressure(*s))}
    assert got.keys() == want.keys()
    close([got[k] for k in want], list(want.values()))


def test_slot_bound_is_enforced(spark, scene_tables):
    poses, clips = scene_tables
    with pytest.raises(Exception, match="person slot outside the declared 2"):
        people.crowd_pressure(people.person_stats(poses), clips, max_persons=2).collect()


@pytest.mark.parametrize("gate,limit,slots", [(0.0, 16, 16), (95.0, 2, 16), (0.0, 1, 100)])
def test_candidate_pairs(spark, tiny_chunks, scenes, scene_tables, gate, limit, slots, monkeypatch):
    if slots > people.ROW_SLOTS:
        monkeypatch.setattr(people, "ROW_SLOTS", 2)
    poses, clips = scene_tables
    found = people.candidate_pairs(
        people.person_stats(poses), clips, 8, 4, max_pairs=limit, min_pair_height=gate, max_persons=slots
    )
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault((r["clip_id"], r["start"]), []).append((r["i"], r["j"]))
    want = {}
    for clip, (points, scores) in scenes.items():
        for s in np_starts(len(points), 8, 4):
            pairs = sql_pairs(points[s : s + 8], scores[s : s + 8], limit=limit, gate=gate)
            if pairs:
                want[clip, s] = pairs
    assert got == want


def test_pairs_far_away_or_alone(spark):
    points = np.zeros((8, 4, 17, 2))
    points[..., 1] = np.linspace(0, 60, 17)
    points[:, 1, :, 0] += 40
    points[:, 2, :, 0] += 900
    scores = np.ones((8, 4, 17))
    scores[:, 3] = 0
    poses, clips = poses_frame(spark, {"a": (points, scores)}), clips_frame(spark, {"a": 8})
    found = people.candidate_pairs(people.person_stats(poses), clips)
    assert [(r["i"], r["j"]) for r in found.collect()] == [(0, 1)]
    alone = people.candidate_pairs(people.person_stats(poses.filter("person = 0")), clips)
    assert alone.count() == 0


# --- signals ---------------------------------------------------------------------------------------------


def series_frame(spark, series):
    rows = [(c, f, float(v)) for c, values in series.items() for f, v in enumerate(values)]
    return spark.createDataFrame(rows, "clip_id string, frame int, score double")


def by_clip(df, column):
    found = {}
    for r in df.orderBy("frame").collect():
        found.setdefault(r["clip_id"], []).append(r[column])
    return found


@relaxed
@given(st.lists(st.integers(0, 100), min_size=1, max_size=120), st.integers(1, 20), st.integers(0, 25))
def test_smoothing_and_spikes(spark, tiny_chunks, values, width, back):
    values = [v / 100 for v in values]
    df = series_frame(spark, {"a": values, "b": values[::-1]})
    close(by_clip(signals.moving_average(df, "score", width), "smooth")["a"], np_average(values, width))
    close(by_clip(signals.pressure_spikes(df, "score", back), "spike")["b"], sql_spikes(values[::-1], back))


def test_normalize_signal(spark, tiny_chunks):
    df = series_frame(spark, {"a": list(range(20)), "b": [3.0] * 9})
    got = by_clip(signals.normalize_signal(df, "score"), "scaled")
    close(got["a"], np.arange(20) / 19)
    assert got["b"] == [0.0] * 9


def test_frame_scores_overlap(spark):
    scores = spark.createDataFrame(
        [("a", 0, 1.0, (0, 1)), ("a", 2, 0.0, (1, 2))], "clip_id string, start int, prob double, pair struct<i:int,j:int>"
    )
    curve = signals.frame_scores(scores, clips_frame(spark, {"a": 6, "empty": 2}), 4)
    got = by_clip(curve, "score")
    assert got == {"a": [1, 1, 0.5, 0.5, 0, 0], "empty": [0.0, 0.0]}
    assert by_clip(curve, "pair")["a"] == [(0, 1)] * 4 + [(1, 2)] * 2


def test_motion(spark, tiny_chunks, scenes, scene_tables):
    poses, clips = scene_tables
    rows = signals.person_motion(poses)
    got = {(r["clip_id"], r["frame"], r["person"]): r["motion"] for r in rows.collect()}
    for clip, scene in scenes.items():
        want = sql_motion(*scene)
        close([got.get((clip, *at), 0.0) for at in np.ndindex(want.shape)], want.ravel())
        energy = by_clip(signals.motion_energy(rows, clips), "energy")[clip]
        close(energy, want.max(axis=1))


def test_motion_is_scale_free(spark):
    points = np.zeros((4, 2, 17, 2))
    points[..., 1] = np.linspace(0, 50, 17)
    points[:, 0, :, 0] = 5 * np.arange(4)[:, None]
    scores = np.ones((4, 2, 17))
    for factor in (1, 4):
        poses = poses_frame(spark, {"a": (points * factor, scores)})
        energy = by_clip(signals.motion_energy(signals.person_motion(poses), clips_frame(spark, {"a": 4})), "energy")
        close(energy["a"], [0, 0.1, 0.1, 0.1])


@pytest.mark.parametrize("slots", [16, 100])
def test_activity_pairs(spark, tiny_chunks, scenes, scene_tables, slots):
    poses, clips = scene_tables
    rows = signals.person_frames(poses)
    got = by_clip(
        signals.activity_pairs(rows.filter("n > 0"), rows, clips, 5, max_persons=slots), "pair"
    )
    for clip, (points, scores) in scenes.items():
        motion = sql_motion(points, scores)
        smooth = np.stack([np_average(motion[:, m], 5) for m in range(motion.shape[1])], axis=1)
        for t in range(len(points)):
            lead = max(range(motion.shape[1]), key=lambda m: (smooth[t, m], m))
            shown = [m for m in range(motion.shape[1]) if (scores[t, m] > 0).any()]
            want = None
            if smooth[t, lead] > 1e-12 and lead in shown and len(shown) > 1:
                centre = {m: points[t, m][scores[t, m] > 0].mean(axis=0) for m in shown}
                near = min((np.hypot(*(centre[m] - centre[lead])), m) for m in shown if m != lead)[1]
                want = (min(lead, near), max(lead, near))
            assert (tuple(got[clip][t]) if got[clip][t] else None) == want


# --- incidents --------------------------------------------------------------------------------------------


@relaxed
@given(
    st.lists(st.integers(0, 10), min_size=1, max_size=150),
    st.sampled_from([(1, 0), (4, 0), (8, 2), (1, 5), (3, 40)]),
)
def test_incidents(spark, tiny_chunks, values, shape):
    window, gap = shape
    df = series_frame(spark, {"hot": [v / 10 for v in values], "b": [0.9, float("nan"), 0.1]})
    found = incidents.find_incidents(df, window, 0.5, gap, start="frame")
    got = sorted((r["start"], r["end"], r["peak"]) for r in found.collect() if r["clip_id"] == "hot")
    assert got == sql_incidents([v / 10 for v in values], range(len(values)), window, 0.5, gap)


def test_incidents_on_sparse_starts(spark):
    df = spark.createDataFrame([("a", 0, 0.9), ("a", 16, 0.8), ("a", 48, 0.7)], "clip_id string, start int, score double")
    rows = incidents.find_incidents(df, 32).collect()
    assert [(r["start"], r["end"], r["peak"]) for r in rows] == [(0, 80, 0.9)]
    far = spark.createDataFrame([("a", 0, 0.9), ("a", 40, 0.8)], "clip_id string, start int, score double")
    assert incidents.find_incidents(far, 32).count() == 2
    assert incidents.find_incidents(far, 32, max_gap=8).count() == 1


def test_long_run_through_many_chunks(spark, tiny_chunks):
    df = series_frame(spark, {"a": [1.0] * 300 + [0.0] * 50 + [1.0] * 70})
    rows = sorted(tuple(r) for r in incidents.find_incidents(df, 1, start="frame").collect())
    assert rows == [("a", 0, 300, 1.0), ("a", 350, 420, 1.0)]


def incident_rows(spark, rows):
    return spark.createDataFrame(rows, "clip_id string, start int, end int, peak double")


def test_top_and_trigger_and_marks(spark, tiny_chunks):
    scores = series_frame(spark, {"a": [0.9] * 10 + [0.2] * 10 + [0.8] * 10 + [0.1] * 5 + [0.7] * 5})
    clips = clips_frame(spark, {"a": 40})
    found = incidents.find_incidents(scores, 1, start="frame")
    lowered, kept = incidents.keep_top_incidents(scores, found, 0.5, 1)
    assert [(r["start"], r["end"]) for r in kept.collect()] == [(0, 10)]
    close(by_clip(lowered, "score")["a"], [0.9] * 10 + [0.2] * 10 + [0.45] * 10 + [0.1] * 5 + [0.45] * 5)
    peaks = spark.createDataFrame([("a", 25, 40)], "clip_id string, peak_frame int, frames bigint")
    first = incidents.earliest_before(found, peaks, clips, 3).first()
    assert (first["start"], first["end"], first["peak"]) == (0, 13, 0.9)
    marks = spark.createDataFrame([("a", "1.55-1.9"), ("a", "9-12"), ("a", "1.6-1.65")], "clip_id string, mark string")
    spans = incidents.parse_marks(marks, clips, 10.0)
    assert sorted((r["start"], r["end"]) for r in spans.collect()) == [(15, 19)]
    lifted, merged = incidents.add_marks(scores, found, spans, 0.5)
    assert merged.count() == 4
    curve = by_clip(lifted, "score")["a"]
    assert curve[14:20] == [0.2, 0.51, 0.51, 0.51, 0.51, 0.2]
    report = {(r["start"], r["is_manual"]) for r in incidents.incident_report(merged, spans).collect()}
    assert report == {(0, False), (15, True), (20, False), (35, False)}


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5, 0.9, 1.0])
def test_matching(spark, threshold):
    rng = np.random.default_rng(8)

    def spans(n):
        starts = rng.integers(0, 300, n)
        return [(f"s{i % 2}", int(s), int(s + rng.integers(1, 90)), 0.5) for i, s in enumerate(starts)]

    truth, found = spans(60), spans(80)
    found[0] = truth[0]

    def ratio(a, b):
        shared = max(0, min(a[2], b[2]) - max(a[1], b[1]))
        return shared / ((a[2] - a[1]) + (b[2] - b[1]) - shared)

    want = {i for i, g in enumerate(truth) if any(p[0] == g[0] and ratio(g, p) >= threshold for p in found)}
    numbered = spark.createDataFrame(
        [(*g, i) for i, g in enumerate(truth)], "clip_id string, start int, end int, peak double, gt_id int"
    )
    hits = incidents.matched_truth(incident_rows(spark, found), numbered, threshold)
    assert {r["gt_id"] for r in hits.collect()} == want
    counts = incidents.match_counts(incident_rows(spark, found), numbered, threshold)
    assert counts.agg(F.sum("matched")).first()[0] == len(want)
    assert incidents.matched_truth(incident_rows(spark, []), numbered, 0.5).count() == 0


def test_kinds(spark):
    rows = [(0.6, True, True, "MANUAL MARK"), (0.6, False, True, "HIGH ACTIVITY"), (0.6, False, False, "AGGRESSION"),
            (0.4, True, True, "monitoring")]
    df = spark.createDataFrame(rows, "score double, m boolean, a boolean, want string")
    kind = incidents.flag_kind(F.col("score"), 0.5, F.col("m"), F.col("a"))
    assert all(r["want"] == r["got"] for r in df.withColumn("got", kind).collect())


def test_scalar_functions(spark):
    row = spark.range(1).select(
        temporal_iou(F.lit(0), F.lit(10), F.lit(5), F.lit(15)).alias("a"),
        temporal_iou(F.lit(3), F.lit(3), F.lit(3), F.lit(3)).alias("b"),
        softmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("c"),
        argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("d"),
    ).first()
    assert row["a"] == pytest.approx(1 / 3) and row["b"] == 0.0 and row["d"] == 1
    close(row["c"], np.exp([-2, 0, 0]) / np.exp([-2, 0, 0]).sum())


# --- ingest --------------------------------------------------------------------------------------------------


def test_annotations(spark, tiny_chunks):
    def flat(v, n=26):
        return [float(k) for j in range(n) for k in (j + 1, j + 2, v)]

    images = spark.createDataFrame(
        [("d", 1, "punching\\x\\clip/12.png", 0), ("d", 2, "punching/x/clip/30.png", 1), ("d", 3, "walk/y/7.png", 2),
         ("d", 3, "walk/y/8.png", 3)],
        "source string, id bigint, file_name string, pos bigint",
    )
    notes = spark.createDataFrame(
        [("d", 1, flat(2.0), 0.5, 0), ("d", 1, flat(1.0), 0.9, 1), ("d", 1, flat(0.0), 0.9, 2), ("d", 2, flat(2.0, 17), None, 3),
         ("d", 9, flat(2.0), 0.5, 4), ("d", 3, flat(2.0), 0.1, 5)],
        "source string, image_id bigint, keypoints array<double>, score double, pos bigint",
    )
    rows = {(r["clip"], r["frame"], r["person"]): r for r in ingest.group_annotations(images, notes).collect()}
    assert set(rows) == {("punching/x/clip", 0, 0), ("punching/x/clip", 0, 1), ("punching/x/clip", 1, 0), ("walk/y", 0, 0)}
    first, second = rows["punching/x/clip", 0, 0]["joints"], rows["punching/x/clip", 0, 1]["joints"]
    assert len(first) == 17 and first[3]["s"] == 0.5 and (first[3]["x"], first[3]["y"]) == (4.0, 5.0)
    assert second[3]["s"] == 0.0 and second[3]["x"] == 0.0
    assert rows["punching/x/clip", 1, 0]["score"] == 1.0
    assert ingest.group_annotations(images, notes, limit=1).select("clip").distinct().count() == 1
    bad = notes.limit(1).withColumn("keypoints", F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="keypoint list of length 1"):
        ingest.group_annotations(images, bad).collect()


def test_dense_frames_across_chunks(spark, tiny_chunks):
    raw = [3, 3, 9, 40, 41, 200, 1000]
    df = spark.createDataFrame([("a", f) for f in raw], "clip string, frame int")
    got = sorted(r["frame"] for r in ingest.dense_frames(df).collect())
    assert got == [0, 0, 1, 2, 3, 4, 5]


def test_densify(spark):
    scene = random_scene(2, 4, 3)
    poses = poses_frame(spark, {"a": scene})
    full = ingest.densify(poses, clips_frame(spark, {"a": 6}), 2)
    assert full.count() == 12
    assert all(len(r["joints"]) == 17 for r in full.collect())
    assert all(j["s"] == 0 for r in full.filter("frame > 3").collect() for j in r["joints"])


# --- features -----------------------------------------------------------------------------------------------------


def np_normalized(points, scores):
    shown = scores > 0
    if not shown.any():
        return points
    used = points[shown]
    return np.where(shown[..., None], (points - used.mean(axis=0)) / (used.std() + 1e-6), 0.0)


def np_tensor(points, scores, target, normalize):
    if normalize:
        points = np_normalized(points, scores)
    pick = np.minimum(np.arange(target), len(points) - 1)
    full = np.concatenate([points, scores[..., None]], axis=-1)[pick]
    return full.transpose(3, 0, 2, 1)


@pytest.fixture(scope="module")
def dense_tables(spark, scenes):
    shown = {k: (p[:, :2], s[:, :2]) for k, (p, s) in scenes.items()}
    return shown, poses_frame(spark, shown, skip_hidden=False), clips_frame(spark, {k: len(v[0]) for k, v in shown.items()})


def test_normalize_clips(spark, tiny_chunks, dense_tables):
    shown, poses, _ = dense_tables
    for r in features.normalize_clips(poses).collect():
        want = np_normalized(*shown[r["clip_id"]])[r["frame"], r["person"]]
        close([(j["x"], j["y"]) for j in r["joints"]], want, 1e-7)


def test_normalization_ignores_resolution_and_empty_clips(spark):
    rng = np.random.default_rng(0)
    base, ones = rng.normal(size=(6, 2, 17, 2)), np.ones((6, 2, 17))
    both = {"a": (base * 50 + 10, ones), "b": (base * 1000 + 500, ones), "none": (base, ones * 0)}
    rows = features.normalize_clips(poses_frame(spark, both, skip_hidden=False)).collect()
    got = {(r["clip_id"], r["frame"], r["person"]): [(j["x"], j["y"]) for j in r["joints"]] for r in rows}
    for t in range(6):
        close(got["a", t, 1], got["b", t, 1], 1e-3)
        close(got["none", t, 0], base[t, 0])


@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize("target", [5, 32])
def test_tensor_and_features(spark, dense_tables, normalize, target):
    shown, poses, clips = dense_tables
    tensors = {r["clip_id"]: r["tensor"] for r in features.clip_tensors(poses, clips, target, 2, normalize).collect()}
    joint = {r["clip_id"]: r["features"] for r in features.clip_features(poses, clips, target, 2, normalize).collect()}
    pooled = {
        r["clip_id"]: r["features"]
        for r in features.clip_features(poses, clips, target, 2, normalize, level="pooled").collect()
    }
    for clip, scene in shown.items():
        want = np_tensor(*scene, target, normalize)
        assert np.allclose(tensors[clip], want.ravel(), rtol=1e-5, atol=1e-4)
        means, devs = want.mean(axis=(1, 3)), want.std(axis=(1, 3))
        close(joint[clip], np.stack([means, devs], axis=-1).ravel(), 1e-5)
        close(pooled[clip], [v for c in want for v in (c.mean(), c.std())], 1e-5)


def test_pair_features(spark, tiny_chunks, scenes, scene_tables):
    poses, clips = scene_tables
    pairs = people.candidate_pairs(people.person_stats(poses), clips, 8, 4)
    rows = features.pair_features(poses, clips, pairs, 8, 4, level="pooled").collect()
    assert len(rows) == pairs.count() > 10
    for r in rows:
        points, scores = scenes[r["clip_id"]]
        cut = slice(r["start"], r["start"] + 8)
        members = [r["i"], r["j"]]
        hidden = ~(scores[cut][:, members] > 0).any(axis=2)
        kp, sc = points[cut][:, members].copy(), scores[cut][:, members]
        kp[hidden] = 0
        want = np_tensor(kp, sc, 8, True)
        close(r["features"], [v for c in want for v in (c.mean(), c.std())], 1e-5)


def test_graph(spark):
    edges = dims.skeleton_edges()
    assert len([e for e in edges if e[0] == 0]) == 17 and len([e for e in edges if e[0] == 1]) == 38
    assert len(dims.skeleton_edges("uniform")) == 17 + 38
    scene = random_scene(1, 2, 1, hidden=0.0)
    poses = poses_frame(spark, {"a": scene}, skip_hidden=False)
    adjacency = np.zeros((3, 17, 17))
    for k, v, w, weight in edges:
        adjacency[k, v, w] = weight
    assert np.allclose(adjacency[1], adjacency[1].T)
    for r in poses.withColumn("sums", features.neighbour_sums(F.col("joints"))).collect():
        x = scene[0][r["frame"], r["person"], :, 0]
        got = [[j["x"] for j in part] for part in r["sums"]]
        close(got, np.einsum("v,kvw->kw", x, adjacency), 1e-6)
    table = {tuple(r) for r in dims.skeleton_edge_table(spark).collect()}
    assert table == set(edges)


def test_standardize(spark, dense_tables):
    _, poses, _ = dense_tables
    rows = features.standardize_channels(poses, 2).collect()
    values = np.array([[(j["x"], j["y"], j["s"]) for j in r["joints"]] for r in rows if r["person"] == 1])
    close(values.mean(axis=0), 0, 1e-9)
    close(values.std(axis=0), 1, 1e-3)


def test_scorers(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],)], "features array<double>")
    close([r["prob"] for r in scoring.linear_scorer([1.0, -1.0], 0.5)(df).collect()], 1 / (1 + np.exp([0.5, -0.5])))

    def make():
        return lambda batch: batch.sum(axis=1).astype("float32")

    close([r["prob"] for r in scoring.batch_scorer(make, 2)(df).collect()], [3, 0])


# --- metrics -----------------------------------------------------------------------------------------------------------


def test_metrics(spark):
    preds, targets = [0, 1, 1, 2, 2, 2, 9], [0, 1, 2, 2, 2, 0, 1]
    df = spark.createDataFrame(list(zip(preds, targets)), "pred int, target int")
    cm = {(r["target"], r["pred"]): r["n"] for r in metrics.confusion(df, 3).collect()}
    assert len(cm) == 9 and cm[0, 0] == 1 and cm[2, 2] == 2 and cm[2, 1] == 1 and cm[0, 2] == 1 and sum(cm.values()) == 6
    assert metrics.accuracy(df).first()["accuracy"] == pytest.approx(4 / 7)
    assert metrics.accuracy(df.limit(0)).first()["accuracy"] == 0.0
    pr = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in metrics.precision_recall(metrics.confusion(df, 4)).collect()}
    assert pr[3] == (0.0, 0.0, 0) and pr[2] == (pytest.approx(2 / 3), pytest.approx(2 / 3), 3)
    report = {r["name"]: r for r in metrics.report(df, 3, ["neutral"]).collect()}
    assert set(report) == {"neutral", "hug", "kick", "total"} and report["total"]["support"] == 6


def test_split_loss_and_best_model(spark):
    df = spark.createDataFrame([([0.8, 0.2], 0), ([0.4, 0.6], 0)], "probs array<double>, label int")
    row = metrics.split_loss(df).first()
    assert row["loss"] == pytest.approx(-(np.log(0.8) + np.log(0.4)) / 2) and row["accuracy"] == 50.0
    assert tuple(metrics.split_loss(df.limit(0)).first()) == (0.0, 0.0)
    runs = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "epoch int, val_acc double")
    assert metrics.best_model(runs).first()["epoch"] == 2


# --- tracking ----------------------------------------------------------------------------------------------------------


def test_match_slots():
    here = np.array([[0.0, 0.0], [10.0, 10.0]])
    assert tracking.match_slots(here[::-1].copy(), here)[0].tolist() == [1, 0]
    empty = np.full((2, 2), np.nan)
    assert tracking.match_slots(here, empty)[0].tolist() == [0, 1]
    half = np.array([[np.nan, np.nan], [10.0, 10.0]])
    assert tracking.match_slots(np.array([[9.0, 9.0], [1.0, 1.0]]), half)[0].tolist() == [1, 0]
    near = np.array([[0.0, 0.0], [100.0, 0.0]])
    assert tracking.match_slots(np.array([[90.0, 0.0]]), near)[0].tolist() == [1]


def detection_frame(spark, rows):
    def joints(x, y, s):
        return [(float(x), float(y), s)] * 17

    return spark.createDataFrame(
        [(c, f, d, conf, joints(x, y, s)) for c, f, d, conf, x, y, s in rows],
        "clip_id string, frame int, det int, box_conf double, joints array<struct<x:double,y:double,s:double>>",
    )


def test_tracking_swap_topk_and_defaults(spark):
    rows = [("a", 0, 0, 0.9, 0, 0, 1.0), ("a", 0, 1, 0.8, 100, 0, 1.0),
            ("a", 1, 0, 0.8, 101, 0, None), ("a", 1, 1, 0.9, 1, 0, None),
            ("a", 3, 0, 0.9, 104, 0, 1.0),
            ("b", 0, 0, 0.5, 0, 0, 1.0), ("b", 0, 1, 0.9, 50, 0, 1.0), ("b", 0, 2, 0.7, 90, 0, 1.0),
            ("c", 0, 0, None, 7, 0, 0.0)]
    got = {(r["clip_id"], r["frame"], r["person"]): (r["joints"][0]["x"], r["joints"][0]["s"])
           for r in tracking.track(detection_frame(spark, rows)).collect()}
    assert got == {
        ("a", 0, 0): (0.0, 1.0), ("a", 0, 1): (100.0, 1.0), ("a", 1, 0): (1.0, 1.0), ("a", 1, 1): (101.0, 1.0),
        ("a", 3, 1): (104.0, 1.0), ("b", 0, 0): (50.0, 1.0), ("b", 0, 1): (90.0, 1.0), ("c", 0, 0): (7.0, 0.0),
    }


def test_tracking_batches(spark):
    """Small Arrow batches cut clips and frames anywhere; the result must not change."""
    rng = np.random.default_rng(4)
    rows = [(f"c{c}", f, d, float(rng.random()), float(rng.uniform(0, 50) + 60 * d), float(rng.uniform(0, 50)), 1.0)
            for c in range(4) for f in range(40) for d in range(rng.integers(0, 4))]
    df = detection_frame(spark, rows)
    want = sorted(map(tuple, tracking.track(df, 3).select("clip_id", "frame", "person", F.col("joints")[0]["x"]).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, tracking.track(df, 3).select("clip_id", "frame", "person", F.col("joints")[0]["x"]).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == len(rows)


def scan_in_order(rows, max_persons):
    """Slots of (clip, frame, rank, cx, cy, vx, vy) rows, one frame after the other."""
    found, slots = [], {}
    for (clip, frame), part in pd.DataFrame(rows, columns="clip frame rank cx cy vx vy".split()).sort_values(["clip", "frame", "rank"]).groupby(["clip", "frame"]):
        own = slots.setdefault(clip, np.full((max_persons, 2), np.nan))
        given, _ = tracking.advance(part[["cx", "cy"]].to_numpy(float), part[["vx", "vy"]].to_numpy(float), own)
        found += [(clip, frame, rank, int(person)) for rank, person in zip(part["rank"], given, strict=True)]
    return sorted(found)


@pytest.mark.parametrize("max_persons, grid", [(2, None), (3, None), (3, 4)])
def test_slots_of_split_clips(spark, tiny_chunks, max_persons, grid):
    """Clips cut into many segments, one without any full frame, and coarse positions full of ties."""
    rng = np.random.default_rng(4)
    rows = []
    for clip, frames in (("a", 120), ("b", 70), ("c", 5), ("bare", 40)):
        for frame in sorted(rng.choice(3 * frames, frames, replace=False).tolist()):
            people = int(rng.integers(1, max_persons if clip == "bare" else max_persons + 1))
            for rank in range(people):
                spot = rng.uniform(0, 100, 4)
                rows.append((clip, frame, rank, *(np.floor(spot / 100 * grid) if grid else spot).tolist()))
    df = spark.createDataFrame(rows, "clip_id string, frame int, rank int, cx double, cy double, vx double, vy double")
    segments = tracking._segments(df, max_persons, "clip_id").select("clip_id", "segment").distinct().groupBy("clip_id").count()
    assert {r[0] for r in segments.filter("count > 5").collect()} == {"a", "b"}
    got = tracking.assign_slots(df, max_persons).select("clip_id", "frame", "rank", "person")
    assert sorted(map(tuple, got.collect())) == scan_in_order(rows, max_persons)


def test_frame_scores_deals_frames_out_by_their_number(spark, tiny_chunks, monkeypatch):
    """More frames are more tasks, not larger ones; the curve stays the same."""
    clips = spark.createDataFrame([("a", 300), ("b", 7), ("c", 0)], "clip_id string, num_frames int")
    scores = [("a", s, (s % 7) / 7.0) for s in range(0, 290, 3)] + [("b", 0, 0.5)]
    frame = spark.createDataFrame(scores, "clip_id string, start int, prob double")
    monkeypatch.setattr(signals, "TASK_FRAMES", 32)
    curve = signals.frame_scores(frame, clips, 10)
    assert curve.rdd.getNumPartitions() >= 9
    found = {(r["clip_id"], r["frame"]): r["score"] for r in curve.collect()}
    length = {"a": 300, "b": 7}
    assert set(found) == {(c, f) for c, n in length.items() for f in range(n)}
    for (clip, at), score in found.items():
        held = [p for c, s, p in scores if c == clip and s <= at < s + 10]
        assert score == pytest.approx(sum(held) / len(held) if held else 0.0)
