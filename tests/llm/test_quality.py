import numpy as np
from pyspark.sql import functions as F

from kinetable.llm import quality
from kinetable.llm.common import id_crc


def brute_isotonic(value, weight):
    """By the max-min formula."""
    n = len(value)
    mean = lambda a, b: np.average(value[a : b + 1], weights=weight[a : b + 1])
    return [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


def test_isotonic():
    random = np.random.default_rng(1)
    for n in (0, 1, 2, 40):
        value, weight = random.random(n), random.integers(1, 9, n).astype(float)
        assert np.allclose(quality.isotonic(value, weight), brute_isotonic(value, weight))


def test_features_approximate_a_gaussian_kernel():
    random = np.random.default_rng(2)
    x = random.standard_normal((30, quality.STATISTICS))
    directions = np.random.default_rng(3).standard_normal((quality.STATISTICS, 20_000)) / np.sqrt(quality.STATISTICS)
    z = quality._features(x, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), directions, random.uniform(0, 2 * np.pi, 20_000))[:, 1:]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.STATISTICS))
    assert np.abs(z @ z.T - want).max() < 0.05


def with_stats(docs):
    return docs.withColumn("stats", quality.document_statistics(docs.sparkSession, F.col("text")))


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    docs = with_stats(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("held_out", id_crc() % 5 == 0)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.where(~F.col("held_out")), labels)
    rows = docs.where("held_out").join(labels, "doc_id").select("label", quality.score(spark, F.col("stats"), model).alias("score")).collect()
    good, bad = ([r["score"] for r in rows if r["label"] == k] for k in (1, 0))
    assert good and bad
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([g >= quality.KEEP for g in good]) > 0.97


def test_normal_equations_do_not_depend_on_partitions(small):
    sf = "/root/testdata/sf0.001"
    labels = small.sparkSession.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    one, many = (quality.fit(with_stats(small).repartition(n), labels) for n in (1, 7))
    assert np.allclose(one.weights, many.weights, atol=1e-6)


def test_messy_and_empty(messy, empty):
    spark = messy.sparkSession
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1), (5, 0), (99, 0)], "doc_id long, label int")
    docs = with_stats(messy)
    model = quality.fit(docs, labels)
    out = docs.withColumn("score", quality.score(spark, F.col("stats"), model)).collect()
    assert len(out) == messy.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(len(r["stats"]) == quality.STATISTICS and np.isfinite(r["stats"]).all() for r in out)
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.fit(with_stats(empty), labels) is None
    assert {r["score"] for r in docs.withColumn("score", quality.score(spark, F.col("stats"), None)).collect()} == {0.5}
    assert with_stats(empty).count() == 0
