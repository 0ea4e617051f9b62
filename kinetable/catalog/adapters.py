"""The driver's tables read as pose and event-stream inputs, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinetable.operators.chunks import number_rows


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the files once per session.

    Its timestamps carry no zone; they are read as UTC.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# --- events as an event camera --------------------------------------------------------


def sensor_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("segment"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        ((F.col("event_id") * 37) % 20 - 2).cast("double").alias("x"),
        ((F.col("event_id") * 53) % 16 - 2).cast("double").alias("y"),
        F.when(F.col("event_type").isin("click", "purchase"), 1.0)
        .when(F.col("event_type") == "view", 0.0)
        .otherwise(-1.0)
        .alias("p"),
    )


SENSOR_EVENTS = """
sensor AS (
  SELECT cast(user_id AS varchar) AS segment, epoch_us(ts) AS t_us,
         cast((event_id*37)%20-2 AS double) AS x, cast((event_id*53)%16-2 AS double) AS y,
         CASE WHEN event_type IN ('click','purchase') THEN 1.0 WHEN event_type = 'view' THEN 0.0
              ELSE -1.0 END AS p
  FROM events)"""


# --- embeddings as skeletons -------------------------------------------------------------


def vector_poses(spark: SparkSession, sf: str) -> DataFrame:
    """40 vectors per clip: 10 frames of 4 people."""
    joints = F.expr(
        "transform(sequence(0, 16), j -> struct("
        "cast(embedding[2*j] AS double)*1000 + 100*(vec_id%4) AS x,"
        "cast(embedding[2*j+1] AS double)*1000 AS y,"
        "greatest(cast(embedding[34+j] AS double)*5, 0.0D) AS s))"
    )
    return table(spark, sf, "embeddings").select(
        F.expr("concat('clip_', lpad(cast(vec_id div 40 AS string), 6, '0'))").alias("clip_id"),
        F.expr("cast((vec_id % 40) div 4 AS int)").alias("frame"),
        F.expr("cast(vec_id % 4 AS int)").alias("person"),
        joints.alias("joints"),
    )


def vector_clips(spark: SparkSession, sf: str) -> DataFrame:
    """One row per clip with its length and a dataset tag from the label of its first vector."""
    return (
        table(spark, sf, "embeddings")
        .groupBy(F.expr("concat('clip_', lpad(cast(vec_id div 40 AS string), 6, '0'))").alias("clip_id"))
        .agg(
            (F.max(F.expr("(vec_id % 40) div 4")) + 1).cast("int").alias("num_frames"),
            F.expr("concat('set_', cast(min_by(label, vec_id) % 3 AS string))").alias("dataset"),
        )
    )


VECTOR_JOINTS = """
pj AS (
  SELECT 'clip_' || lpad(cast(vec_id//40 AS varchar), 6, '0') AS clip_id,
         cast((vec_id%40)//4 AS int) AS frame, cast(vec_id%4 AS int) AS person, cast(r.j AS int) AS j,
         cast(embedding[2*r.j+1] AS double)*1000 + 100*(vec_id%4) AS x,
         cast(embedding[2*r.j+2] AS double)*1000 AS y,
         greatest(cast(embedding[35+r.j] AS double)*5, 0.0) AS s
  FROM embeddings, range(17) r(j))"""

VECTOR_CLIPS = """
clips AS (
  SELECT 'clip_' || lpad(cast(vec_id//40 AS varchar), 6, '0') AS clip_id,
         cast(max((vec_id%40)//4)+1 AS int) AS num_frames,
         'set_' || cast(arg_min(label, vec_id)%3 AS varchar) AS dataset
  FROM embeddings GROUP BY 1)"""

SPINE = """
spine AS (SELECT clip_id, cast(unnest(range(num_frames)) AS int) AS frame FROM clips)"""

PERSON_STATS = """
stats AS (
  SELECT clip_id, frame, person, count(*) AS n, sum(x) AS sx, sum(y) AS sy, avg(x) AS cx, avg(y) AS cy,
         min(y) AS low, max(y) AS high
  FROM pj WHERE s > 0 GROUP BY 1, 2, 3)"""


# --- frame score streams -------------------------------------------------------------------


def score_streams(spark: SparkSession, sf: str) -> DataFrame:
    """One stream per user: events in time order are frames, scaled values are scores."""
    events = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("clip_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"),
    )
    return number_rows(
        events, "clip_id", F.expr("unix_micros(ts) div 3600000000L"), [F.col("ts"), F.col("event_id")], "frame"
    ).select("clip_id", "frame", "score")


def stream_clips(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").cast("string").alias("clip_id"))
        .agg(F.count("*").cast("int").alias("num_frames"))
    )


SCORE_STREAMS = """
fs AS (
  SELECT cast(user_id AS varchar) AS clip_id,
         cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS int) AS frame,
         least(value/100, 1.0::double) AS score
  FROM events)"""

STREAM_CLIPS = """
clips AS (SELECT cast(user_id AS varchar) AS clip_id, cast(count(*) AS int) AS num_frames
          FROM events GROUP BY 1)"""


def long_score_streams(spark: SparkSession, sf: str) -> DataFrame:
    """One long stream per supplier, for the benchmark."""
    order = [
        F.col(c)
        for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                  "l_extendedprice", "l_discount")
    ]
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("clip_id"), *order,
        (F.col("l_discount") * 10).alias("score"),
    )
    return number_rows(lines, "clip_id", F.col("l_shipdate"), order, "frame").select(
        "clip_id", "frame", "score"
    )


def long_stream_clips(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("clip_id"))
        .agg(F.count("*").cast("int").alias("num_frames"))
    )


LONG_SCORE_STREAMS = """
fs AS (
  SELECT cast(l_suppkey AS varchar) AS clip_id,
         cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
              l_partkey, l_quantity, l_extendedprice, l_discount) - 1 AS int) AS frame,
         l_discount*10 AS score
  FROM lineitem)"""

LONG_STREAM_CLIPS = """
clips AS (SELECT cast(l_suppkey AS varchar) AS clip_id, cast(count(*) AS int) AS num_frames
          FROM lineitem GROUP BY 1)"""


# --- events as skeletons -----------------------------------------------------------------------


def event_poses(spark: SparkSession, sf: str) -> DataFrame:
    """One clip per user: four consecutive events are the four people of a frame."""
    events = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("clip_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id"
    )
    numbered = number_rows(
        events, "clip_id", F.expr("unix_micros(ts) div 3600000000L"), [F.col("ts"), F.col("event_id")], "rn"
    )
    # Written out joint by joint, so that it compiles instead of running a lambda per joint.
    joints = F.expr(
        "array("
        + ",".join(
            f"struct(double((event_id*31 + {j * 17}) % 1000) AS x, double((event_id*13 + {j * 29}) % 700) AS y,"
            f" if((event_id + {j}) % 5 > 0, 1.0D, 0.0D) AS s)"
            for j in range(17)
        )
        + ")"
    )
    return numbered.select(
        "clip_id",
        F.expr("rn div 4").cast("int").alias("frame"),
        (F.col("rn") % 4).cast("int").alias("person"),
        joints.alias("joints"),
    )


def event_clips(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").cast("string").alias("clip_id"))
        .agg(F.expr("cast((count(*) + 3) div 4 AS int)").alias("num_frames"))
    )


EVENT_JOINTS = """
rn AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn
       FROM events),
pj AS (
  SELECT cast(user_id AS varchar) AS clip_id, cast(rn//4 AS int) AS frame, cast(rn%4 AS int) AS person,
         cast(r.j AS int) AS j, cast((event_id*31 + r.j*17) % 1000 AS double) AS x,
         cast((event_id*13 + r.j*29) % 700 AS double) AS y,
         CASE WHEN (event_id + r.j) % 5 > 0 THEN 1.0::double ELSE 0.0 END AS s
  FROM rn, range(17) r(j))"""

EVENT_CLIPS = """
clips AS (SELECT cast(user_id AS varchar) AS clip_id, cast((count(*)+3)//4 AS int) AS num_frames
          FROM events GROUP BY 1)"""


# --- clip names, predictions ---------------------------------------------------------------------


def clip_paths(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(
        *[F.lit(w) for w in ("slap", "punching", "hair_grab", "finger_guessing", "seq_kick",
                             "seq_hug", "mystery", "handshake", "walk")]
    )
    key = F.col("p_partkey")
    dataset = F.when(key % 3 == 0, "ut_interaction").when(key % 3 == 1, "set_b").otherwise("set_c")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(
            F.lit("root/"), words[(key % 9).cast("int")], F.lit("_"), F.col("p_size").cast("string"), F.lit(".npz")
        ).alias("path"),
        dataset.alias("dataset"),
        F.when((key % 5 != 0) & (key % 3 != 0), key % 2 == 0).alias("aggressive"),
    )


CLIP_PATHS = """
cp AS (
  SELECT p_partkey,
         'root/' || (['slap','punching','hair_grab','finger_guessing','seq_kick','seq_hug','mystery',
                      'handshake','walk'])[p_partkey%9+1] || '_' || cast(p_size AS varchar) || '.npz' AS path,
         CASE p_partkey%3 WHEN 0 THEN 'ut_interaction' WHEN 1 THEN 'set_b' ELSE 'set_c' END AS dataset,
         CASE WHEN p_partkey%5 <> 0 AND p_partkey%3 <> 0 THEN p_partkey%2 = 0 END AS aggressive
  FROM part)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    labels, documents = table(spark, sf, "labels"), table(spark, sf, "documents")
    return labels.join(documents.select("doc_id", "lang"), "doc_id").select(
        "doc_id",
        F.col("lang").alias("dataset"),
        F.col("toxic").cast("int").alias("target"),
        F.col("quality").cast("int").alias("pred"),
    )


PREDICTIONS = """
preds AS (
  SELECT l.doc_id, d.lang AS dataset, cast(l.toxic AS int) AS target, cast(l.quality AS int) AS pred
  FROM labels l JOIN documents d USING (doc_id))"""
