import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.llm import ann

SCHEMA = "vec_id long, vector array<float>, score string"


def brute(rows, query, k):
    mine = np.asarray(query["vector"], np.float32).astype(float)
    found = [(-(np.asarray(r["vector"], np.float32).astype(float) * mine).sum(), r["vec_id"]) for r in rows if r["vec_id"] != query["vec_id"]]
    return sorted(set(found))[:k]


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    got = results(ann.nearest(rows, F.col("vec_id") % 20 == 0))
    held = rows.collect()
    queries = [r for r in held if r["vec_id"] % 20 == 0]
    assert set(got) == {r["vec_id"] for r in queries}
    hits = 0
    for q in queries:
        want = brute(held, q, 20)
        exact = {i: -s for s, i in brute(held, q, len(held))}
        assert [r for r, _, _ in got[q["vec_id"]]] == list(range(1, 21))
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in got[q["vec_id"]])
        hits += len({i for _, i, _ in got[q["vec_id"]]} & {i for _, i in want})
    assert hits >= 0.9 * 20 * len(queries)


def test_every_probe_is_exact_with_ties_and_a_hot_vector(spark):
    random = np.random.default_rng(2)
    vectors = [[float(x) for x in np.round(random.standard_normal(4), 1)] for _ in range(60)]
    rows = [(k, vectors[k % 60] if k % 3 else vectors[0], "other") for k in range(600)]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    settings = ann.Settings(tables=1, hashes=2, width=8.0, probes=9, groups=2, chunk=7)
    got = results(ann.nearest(df, F.col("vec_id") % 20 == 0, 20, settings))
    held = df.distinct().collect()
    for q in held:
        if q["vec_id"] % 20 == 0:
            assert [(i, round(s, 9)) for _, i, s in got[q["vec_id"]]] == [(i, round(-s, 9)) for s, i in brute(held, q, 20)]


def test_unusable_vectors_few_candidates_and_empty(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 1.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]),
        (120, [float("nan"), 1.0]), (140, [float("inf"), 1.0]), (None, [1.0, 1.0]), (160, [1.0, 2.0, 3.0]), (0, [1.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, "other") for i, v in rows], SCHEMA)
    settings = ann.Settings(hashes=2, width=8.0, probes=9)
    got = results(ann.nearest(df, F.col("vec_id") % 20 == 0, 20, settings))
    assert got == {0: [(1, 1, 3.0), (2, 20, 0.0)], 20: [(1, 1, 2.0), (2, 0, 0.0)]}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("count", [1, 2, 12, 21, 60])
def test_small_tables_are_complete_with_production_settings(spark, count):
    random = np.random.default_rng(count)
    vectors = random.standard_normal((count, 64))
    rows = [(20 * k if k < count // 2 else 20 * k + 1, v.tolist(), "other") for k, v in enumerate(vectors / np.linalg.norm(vectors, axis=1)[:, None])]
    got = results(ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    queries = [i for i, *_ in rows if i % 20 == 0] if count > 1 else []
    assert set(got) == set(queries) and all(len(got[i]) == min(20, count - 1) for i in queries)
    if count <= 21:
        held = spark.createDataFrame(rows, SCHEMA).collect()
        for q in held:
            if q["vec_id"] in got:
                assert [i for _, i, _ in got[q["vec_id"]]] == [i for _, i in brute(held, q, 20)]


def test_probes_come_in_order_of_their_score():
    cells = np.array([[[0.9, 0.5]]])
    order = ann.probes(cells, 9)[0, 0].tolist()
    bucket = lambda *x: int(ann._bucket(np.array(x, np.int64)))
    assert order[:2] == [bucket(0, 0), bucket(1, 0)] and len(set(order)) == 9
