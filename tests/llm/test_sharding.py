from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.llm import sharding


@pytest.mark.parametrize("count", [1, 2, 3, 16, 17, 1000, 4096, 5001])
def test_permutation_and_its_inverse(count):
    rows = np.arange(count)
    out = sharding.permute(rows, count, 42)
    assert sorted(out) == rows.tolist()
    assert np.array_equal(sharding.permute(out, count, 42, back=True), rows)
    assert count < 100 or (np.abs(out - rows) > count // 100).mean() > 0.9
    assert count < 100 or not np.array_equal(out, sharding.permute(rows, count, 43))


def laid_out(df, shards):
    rows = df.collect()
    per = Counter(r["shard"] for r in rows)
    assert set(per) <= set(range(shards))
    counts = [per[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s]))
    return rows


def test_even_gapless_and_computable(small):
    rows = laid_out(sharding.shard_rows(small, [F.col("doc_id")], 16), 16)
    ids = sorted(r["doc_id"] for r in rows)
    for r in rows[:50]:
        assert ids[sharding.row_at(r["shard"], r["slot"], len(ids), 16, 42)] == r["doc_id"]
    again = sharding.shard_rows(small.repartition(3), [F.col("doc_id")], 16)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again.collect()}


def test_hot_key_messy_and_empty(spark, messy, empty):
    hot = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit("x").alias("shard"))
    laid_out(sharding.shard_rows(hot, [F.col("doc_id")], 16), 16)
    assert len(laid_out(sharding.shard_rows(messy, [F.col("doc_id"), F.col("text")], 5), 5)) == messy.count()
    assert sharding.shard_rows(empty, [F.col("doc_id")], 16).count() == 0
