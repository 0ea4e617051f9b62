import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.sources import formats


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def tasks(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("order", ["C", "F"])
def test_one_array_is_many_tasks(known, tmp_path, order):
    rng = np.random.default_rng(1)
    big, small = rng.integers(0, 300, (5000, 4)).astype("<i4"), rng.random((7, 4))
    np.save(tmp_path / "big.npy", np.asarray(big, order=order))
    np.save(tmp_path / "small.npy", small)
    np.save(tmp_path / "none.npy", np.empty((0, 4)))
    df = known.read.format("event_arrays").option("rangeBytes", 8000).load(str(tmp_path))
    assert tasks(df) == 11 and tasks(known.read.format("event_arrays").load(str(tmp_path))) == 1
    got = sorted(map(tuple, df.select("t_us", "x", "y", "p").collect()))
    assert got == sorted([tuple(map(float, r)) for r in big] + [tuple(r) for r in small])
    assert {r[0] for r in df.select("path").distinct().collect()} == {f"file:{tmp_path}/{n}.npy" for n in ("big", "small")}


def test_event_columns_and_ranges_reach_the_reader(known, tmp_path):
    fields = [("timestamp", "<i8"), ("polarity", "i1"), ("x", "<u2"), ("y", "<u2")]
    for k in range(3):
        rows = np.zeros(100, fields)
        rows["timestamp"], rows["x"] = np.arange(100) + 1000 * k, k
        np.save(tmp_path / f"s{k}.npy", rows)
    read = known.read.format("event_arrays").schema("x double, t_us double").option("rangeBytes", 400)
    df = read.load(str(tmp_path))
    assert df.columns == ["x", "t_us"] and df.filter("x = 2").agg(F.min("t_us"), F.count("*")).first()[:] == (2000.0, 100)
    chosen = read.option("pathPattern", "s1[.]npy$").option("firstRow", 40).option("endRow", 70).load(str(tmp_path))
    assert sorted(r["t_us"] for r in chosen.collect()) == list(range(1040, 1070)) and tasks(chosen) == 1
    # A condition on one frame does not touch another one of the same load.
    assert df.filter("t_us < 5").count() == 5 and df.count() == 300


@pytest.mark.parametrize("shape", [(50, 3, 17, 3), (50, 3, 51)])
@pytest.mark.parametrize("order", ["C", "F"])
def test_pose_ranges(known, tmp_path, shape, order):
    values = np.random.default_rng(2).random(shape).astype("<f4")
    stored = np.asarray(values, order=order)
    np.save(tmp_path / "a.npy", stored)
    np.savez(tmp_path / "b.npz", other=np.zeros(3), keypoints=stored)
    np.savez_compressed(tmp_path / "c.npz", stored)
    np.save(tmp_path / "empty.npy", np.empty((4, 0, 51)))
    read = known.read.format("pose_arrays").option("rangeBytes", 5000)
    df = read.load(str(tmp_path))
    flat = values.reshape(50, 3, 51).astype(float)
    for name in ("a.npy", "b.npz", "c.npz"):
        own = df.filter(F.col("path") == f"file:{tmp_path}/{name}")
        got = {(r["frame"], r["person"]): r["keypoints"] for r in own.collect()}
        assert len(got) == 150 and all(np.array_equal(v, flat[f, p]) for (f, p), v in got.items())
    some = read.option("firstRow", 10).option("endRow", 12).load(str(tmp_path)).filter("person = 1")
    assert sorted(r["frame"] for r in some.collect()) == [10, 10, 10, 11, 11, 11] and tasks(some) < tasks(df)
    heads = known.read.format("pose_arrays").option("heads", "true").load(str(tmp_path)).filter("frame is null")
    assert sorted((r["path"].rsplit("/")[-1], r["num_frames"]) for r in heads.collect()) == [
        ("a.npy", 50), ("b.npz", 50), ("c.npz", 50), ("empty.npy", 4)
    ]


def skeleton(frames):
    lines = [str(len(frames))]
    for bodies in frames:
        lines.append(str(len(bodies)))
        for body, value in bodies:
            lines += [f"{body} " + " ".join("0" * 9), "25", *[" ".join([str(value + j)] * 12) for j in range(25)]]
    return "\n".join(lines)


def test_depth_text(known, tmp_path):
    (tmp_path / "S001C001P001R001A050.skeleton").write_text(skeleton([[("7", 1.5), ("8", 2)], [], [("7", 3)]]))
    (tmp_path / "S001C001P001R001A001.skeleton").write_text(skeleton([]))
    df = known.read.format("depth_text").load(str(tmp_path))
    got = sorted((r["path"][-8 - 4 : -9], r["num_frames"], r["frame"], r["pos"], r["body_id"], r["values"][12:13]) for r in df.collect())
    assert got == [("001", 0, -1, -1, None, []), ("050", 3, -1, -1, None, []), ("050", 3, 0, 0, "7", [2.5]), ("050", 3, 0, 1, "8", [3.0]), ("050", 3, 2, 0, "7", [4.0])]
    one = known.read.format("depth_text").option("pathPattern", "A050[^/]*$").load(str(tmp_path))
    assert one.select("path").distinct().count() == 1


@pytest.mark.parametrize("name, write, message", [
    ("event_arrays", lambda p: np.save(p / "a.npy", np.zeros((3, 5))), "four columns"),
    ("event_arrays", lambda p: np.save(p / "a.npy", np.array([{}], object), allow_pickle=True), "objects"),
    ("pose_arrays", lambda p: np.save(p / "a.npy", np.zeros((3, 2, 50))), "need shape"),
    ("pose_arrays", lambda p: zipfile.ZipFile(p / "a.npz", "w").writestr("keypoints.npy", b"xx"), "magic|EOF|short"),
    ("depth_text", lambda p: (p / "a.skeleton").write_text("1 1 7 0 0 0"), "ends|not enough|StopIteration|fewer"),
])
def test_broken_files_raise(known, tmp_path, name, write, message):
    write(tmp_path)
    with pytest.raises(Exception, match=message):
        known.read.format(name).load(str(tmp_path)).collect()
