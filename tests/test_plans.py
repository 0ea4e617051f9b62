import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.config import LocalizeConfig, ReviewConfig
from kinetable.operators import metrics
from kinetable.operators.scoring import linear_scorer, ml_scorer
from kinetable.plans import localize as plan
from kinetable.plans import review as review_plan
from kinetable.plans import training
from tests.helpers import clips_frame, np_starts, poses_frame, random_scene


@pytest.fixture(scope="module")
def tables(spark):
    scenes = {"a": random_scene(11, 60, 4), "b": random_scene(12, 30, 3)}
    return scenes, poses_frame(spark, scenes).cache(), clips_frame(spark, {"a": 60, "b": 30, "empty": 5})


def test_scores_cover_every_window(spark, tables):
    scenes, poses, clips = tables
    cfg = LocalizeConfig(window=16, stride=8)
    scorer = linear_scorer([0.1] * 6)
    pairs = plan.score_pairs(poses, clips, scorer, cfg, level="pooled")
    got = {(r["clip_id"], r["start"]): (r["prob"], r["pair"]) for r in pairs.collect()}
    assert set(got) == {(c, s) for c, t in (("a", 60), ("b", 30), ("empty", 5)) for s in np_starts(t, 16, 8)}
    assert got["empty", 0] == (0.0, None)
    assert all(0 <= p <= 1 and (q is None or q["i"] < q["j"]) for p, q in got.values())
    muted = plan.score_pairs(poses, clips, scorer, LocalizeConfig(window=16, stride=8, min_pair_height=1e6), level="pooled")
    assert all(r["prob"] == 0.0 and r["pair"] is None for r in muted.collect())
    whole = plan.score_windows(poses, clips, scorer, cfg, level="pooled")
    assert {r["clip_id"] for r in whole.collect()} == {"a", "b"}


def test_incident_bounds(spark, tables):
    scenes, poses, clips = tables
    cfg = LocalizeConfig(window=16, stride=8, threshold=0.5, max_gap=0)
    for crowd in (True, False):
        rows = plan.localize(poses, clips, linear_scorer([0.5] * 6), cfg, crowd, "pooled").collect()
        assert rows and all(0 <= r["start"] < r["end"] <= 60 and r["peak"] >= 0.5 for r in rows)


def test_review(spark, tables):
    scenes, poses, clips = tables
    cfg = ReviewConfig(window=16, stride=8, min_pair_height=0.0, max_gap=2, fps=6.0, top_incidents=2)
    marks = spark.createDataFrame([("b", "1-2")], "clip_id string, mark string")
    result = review_plan.review(poses, clips, linear_scorer([0.1] * 6, -0.5), cfg, marks=marks, level="pooled")
    frames = result.frames.collect()
    assert len(frames) == 95
    manual = {(r["clip_id"], r["frame"]) for r in frames if r["is_manual"]}
    assert manual == {("b", f) for f in range(6, 12)}
    assert all(r["kind"] == "MANUAL MARK" for r in frames if r["is_manual"])
    per_clip = {}
    for r in result.incidents.collect():
        per_clip.setdefault(r["clip_id"], []).append(r)
    assert all(len(v) <= 2 + (k == "b") for k, v in per_clip.items())
    for r in result.trigger.collect():
        assert 0 <= r["start"] < r["end"] <= {"a": 60, "b": 30, "empty": 5}[r["clip_id"]]
    two = review_plan.review(
        poses.filter("person < 2"), clips, linear_scorer([0.1] * 6), cfg, crowd=False, level="pooled"
    )
    assert two.trigger is None and two.frames.count() == 95


def separable(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [
        (f"c{i}", f"set_{i % 3}", int(i % 2), [float(v) for v in rng.normal(3.0 * (i % 2), 0.5, 4)])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "clip_id string, dataset string, label int, features array<double>")


def test_training(spark):
    samples = separable(spark)
    model, val, test = training.train_split(samples)
    assert val.first()["accuracy"] > 90 and metrics.accuracy(test).first()["accuracy"] > 0.9
    assert test.count() == int(60 * 0.15)
    pooled = training.pooled_evaluation(samples)
    assert pooled.count() == 12 and metrics.accuracy(pooled).first()["accuracy"] > 0.9
    probs = ml_scorer(model)(samples).select("label", "prob").collect()
    assert all((r["prob"] > 0.5) == (r["label"] == 1) for r in probs)


def test_leave_one_out(spark):
    samples = separable(spark)
    scored = training.leave_one_out(samples, ["set_0", "set_1", "set_2", "absent"])
    matrix, report = training.leave_one_out_report(scored, ["neutral", "aggressive"])
    sums = {r["dataset"]: r["n"] for r in matrix.groupBy("dataset").agg(F.sum("n").alias("n")).collect()}
    assert sums == {"set_0": 20, "set_1": 20, "set_2": 20}
    assert report.filter("name = 'total' and accuracy > 0.9").count() == 3
    assert training.leave_one_out(samples, ["set_0"]).count() == 0
