import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from kinetable.llm import mixing
from kinetable.llm.common import store
from kinetable.llm.queries import ORACLES, QUERIES

from .conftest import SF
from .test_near_texts import brute

NAMES = ["quality", "language", "near_duplicates", "mix", "pack"]


def stages(spark, docs, sf_dir):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    queries = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries) == 1
    assert "pipeline" in queries and set(ORACLES) <= set(QUERIES)


def test_stages_on_a_sample_corpus(spark, small):
    docs, good, spoken, single, mixed, packed = stages(spark, small, SF)
    for df in (good, spoken, single, mixed):
        assert df.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    marked = docs.join(labels, "doc_id")
    kept = marked.join(good.select("doc_id"), "doc_id", "left_semi").groupBy("quality").count().collect()
    kept, all_ = dict(map(tuple, kept)), dict(map(tuple, marked.groupBy("quality").count().collect()))
    assert kept[1] >= 0.97 * all_[1] and kept.get(0, 0) <= 0.2 * all_[0]
    assert spoken.count() >= 0.97 * good.count()
    assert {r[0] for r in single.select("doc_id").collect()} == brute([(r["doc_id"], r["text"]) for r in spoken.collect()])
    drawn = mixing.mix(single.select("doc_id", "source", mixing.word_count().alias("size"))).where("copies > 0")
    want = {r["doc_id"]: r["copies"] for r in drawn.collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(want)
    pieces = packed.groupBy("doc_id", "piece").count().collect()
    assert all(r["count"] == want[r["doc_id"]] for r in pieces)


def test_messy_documents(spark, messy, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    *front, _ = out = stages(spark, messy, str(tmp_path))
    assert all(df.columns == messy.columns for df in front)
    assert {"doc_id", "sequence_id"} <= set(out[-1].columns) and out[-1].count() > 0


@pytest.mark.parametrize("labelled", [True, False])
def test_empty_documents(spark, empty, tmp_path, labelled):
    rows = [(1, 1, 0)] if labelled else []
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [df.count() for df in stages(spark, empty, str(tmp_path))] == [0] * 6


def test_run_reads_the_whole_table(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.agg(F.countDistinct("doc_id")).first()[0] > 100
