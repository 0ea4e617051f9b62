from collections import defaultdict

from pyspark.sql import functions as F

from kinetable.llm import mixing


def filled(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """Targets by sharing the excess again and again."""
    total, target = share * sum(sizes.values()), {}
    free = set(sizes)
    while free:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if cap * sizes[s] <= level * weights[s]}
        if not over:
            target |= {s: level * weights[s] for s in free}
            break
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


def check(rows):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weights = {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}
    want = filled(dict(sizes), weights, 1.5, 2.0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1


def test_targets_and_copies(small):
    rows = mixing.mix(small.select("doc_id", "source", mixing.word_count().alias("size"))).collect()
    assert len(rows) == small.count()
    check(rows)


def test_hot_source_and_repeated_rows(spark):
    hot = spark.range(6000).select((F.col("id") % 7).alias("doc_id"), F.lit("hot").alias("source"), (F.col("id") % 5).alias("size"))
    cold = spark.range(3000).select("id", F.concat(F.lit("s"), F.col("id") % 9).alias("source"), (F.col("id") % 11).alias("size"))
    check(mixing.mix(hot.union(cold)).collect())


def test_messy_rows_and_reruns(messy, empty):
    docs = messy.withColumn("size", mixing.word_count())
    once, again = (mixing.mix(docs) for _ in range(2))
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, once.collect())) == sorted(map(key, again.collect()))
    assert once.count() == docs.count()
    check(once.collect())
    copies = once.agg(F.sum("copies")).first()[0]
    assert mixing.emitted(once).count() == copies
    assert mixing.mix(empty.withColumn("size", mixing.word_count())).count() == 0


def test_words_of_null_and_odd_texts(messy):
    counts = {r["doc_id"]: r["n"] for r in messy.select("doc_id", mixing.word_count().alias("n")).collect()}
    assert (counts[3], counts[4], counts[5], counts[10]) == (0, 0, 0, 2)


def test_main_path_is_native(small):
    plan = mixing.mix(small.select("doc_id", "source", mixing.word_count().alias("size")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
