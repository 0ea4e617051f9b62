"""Hot keys must not end up in one task."""

from pyspark.sql import functions as F

from kinetable.operators import chunks


def shares(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


def settings(spark, **values):
    names = {"broadcast": "spark.sql.autoBroadcastJoinThreshold", "adaptive": "spark.sql.adaptive.enabled",
             "partitions": "spark.sql.shuffle.partitions"}
    before = {names[k]: spark.conf.get(names[k]) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    return before


def test_attached_facts_spread_a_hot_key(spark):
    before = settings(spark, broadcast="-1", adaptive="false", partitions="16")
    try:
        rows = spark.range(20_000).select(
            F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"),
            F.col("id").alias("frame"),
        )
        facts = rows.groupBy("key").agg(F.min("frame").alias("first"), F.count("*").alias("n"))
        joined = chunks.attach_by_key(rows, facts, "key", "n", ["frame"])
        assert joined.count() == 20_000
        assert joined.filter("key = 'hot' and first != 0").count() == 0
        assert shares(joined) < 0.2
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_chunks_spread_a_hot_stream(spark, tiny_chunks):
    before = settings(spark, adaptive="false", partitions="16")
    try:
        rows = spark.range(4_000).select(F.lit("hot").alias("clip_id"), F.col("id").cast("int").alias("frame"))
        halo = chunks.with_halo(rows, back=3, ahead=2).repartition("clip_id", "chunk")
        assert halo.filter("core").count() == 4_000
        assert shares(halo) < 0.2
        spine = chunks.frame_spine(spark.createDataFrame([("hot", 4_000)], "clip_id string, num_frames int"))
        assert spine.count() == 4_000 and shares(spine) < 0.2
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
