"""Keypoint JSON documents: images and annotations.

One document can be gigabytes. The ``flat`` layout reads it as text cut at closing braces,
which Spark splits over many tasks, and puts each image or annotation together again by
the depth of its braces; nested objects and braces in names are allowed, a document whose
braces do not close or an object that does not parse raises an error. The ``document``
layout parses each file as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.schemas import KEYPOINT_ANNOTATION, KEYPOINT_DOCUMENT, KEYPOINT_IMAGE
from kinetable.session import materialize


def read_keypoint_json(
    spark: SparkSession, path: str, layout: str = "flat"
) -> tuple[DataFrame, DataFrame]:
    """(images, annotations). images: source, id, file_name, pos; annotations: source,
    image_id, keypoints, score (NULL if absent), pos. ``pos`` orders objects as in the file."""
    if layout == "flat":
        return _read_flat(spark, path)
    documents = (
        spark.read.schema(KEYPOINT_DOCUMENT)
        .option("multiLine", "true")
        .json(path)
        .withColumn("source", F.col("_metadata.file_path"))
    )

    def unpack(field: str) -> DataFrame:
        rows = documents.select("source", F.posexplode(field).alias("at", "o"))
        position = F.struct(F.lit(0).cast("bigint").alias("block"), F.col("at").cast("bigint").alias("at"))
        return rows.select("source", "o.*", position.alias("pos"))

    return unpack("images"), unpack("annotations")


#: Text up to the next brace, strings in one piece; possessive, so long texts need no stack.
_OUTSIDE = r'(?:[^"{]++|"(?:\\.|[^"\\]++)*+")*+'


def _carried(df: DataFrame, total: Column, name: str) -> DataFrame:
    """Adds the sum of ``total`` over all earlier pieces of the file.

    Pieces are summed inside their block of the file; one row per block crosses blocks.
    """
    keys = ["source", "block"]
    sums = df.groupBy(*keys).agg(F.sum(total).alias("_sum"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_inside", F.coalesce(F.sum(total).over(inside), F.lit(0)))
    return summed.join(base, keys).withColumn(name, F.col("_base") + F.col("_inside")).drop("_base", "_inside")


def _latest(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the last non-null ``value`` of this and all earlier pieces of the file."""
    keys = ["source", "block"]
    lasts = df.groupBy(*keys).agg(F.max_by(value, F.when(value.isNotNull(), F.col("at"))).alias("_last"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = lasts.select(*keys, F.last("_last", ignorenulls=True).over(before).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = df.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return seen.join(base, keys).withColumn(name, F.coalesce("_inside", "_base")).drop("_base", "_inside")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark)))


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """(``source``, ``section``, ``object``, ``pos``) of all objects one level down in documents."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    pieces = pieces.withColumn("plain", F.regexp_replace("value", r"(?s)\\.", ""))
    pieces = materialize(pieces.withColumn("quotes", _count(F.col("plain"), '"')), "json-pieces")
    # Inside a string a brace means nothing: an odd number of quotes before a piece opens one.
    pieces = _carried(pieces, F.col("quotes"), "quoted")
    opened = F.when(F.col("quoted") % 2 == 1, F.lit('"')).otherwise(F.lit(""))
    braces = _count(F.regexp_replace(F.concat(opened, "plain"), r'"[^"]*("|$)', ""), "{")
    closes = ((F.col("quoted") + F.col("quotes")) % 2 == 0).cast("int")
    pieces = pieces.withColumn("braces", braces).withColumn("change", braces - closes)
    pieces = _carried(pieces, F.col("change"), "depth").drop("plain", "quotes", "quoted")
    first = (F.col("depth") < 2) & (F.col("depth") + F.col("braces") >= 2)
    head = F.when(F.col("depth") == 0, F.regexp_extract("value", rf"^{_OUTSIDE}\{{{_OUTSIDE}", 0)).otherwise(
        F.regexp_extract("value", rf"^{_OUTSIDE}", 0)
    )
    pieces = pieces.withColumn("head", F.when(first, head))
    listed = F.regexp_extract("head", r'"((?:\\.|[^"\\])*)"\s*:\s*\[\s*$', 1)
    section = F.when(F.col("head").rlike(r":\s*\[\s*$"), listed).when(F.col("head").rlike(r":\s*$"), F.lit(""))
    pieces = pieces.withColumn("section", section).withColumn("start", F.when(first, F.struct("block", "at")))
    pieces = materialize(pieces, "json-depths")
    pieces = _latest(_latest(pieces, F.col("section"), "in_section"), F.col("start"), "pos")
    # At the end of a whole document every brace is closed; white space may follow as a last piece.
    ends = pieces.groupBy("source").agg(F.sum("change").alias("_left"))
    held = pieces.where(F.col("start").isNotNull() | (F.col("depth") >= 2))
    own = F.when(F.col("start").isNotNull(), F.expr("substring(value, length(head) + 1)")).otherwise(F.col("value"))
    parts = F.sort_array(F.collect_list(F.struct("block", "at", own.alias("text"), F.col("in_section"))))
    whole = held.groupBy("source", "pos").agg(parts.alias("_parts"))
    text = F.concat(F.array_join(F.transform("_parts", lambda p: p["text"]), "}"), F.lit("}"))
    checked = F.when(F.col("_left").isin(0, -1), text).otherwise(
        F.raise_error(F.concat(F.lit("braces do not close in "), F.col("source"))).cast("string")
    )
    return whole.join(ends, "source").select(
        "source", F.col("_parts")[0]["in_section"].alias("section"), checked.alias("object"), "pos"
    )


def _read_flat(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    objects = materialize(_objects(spark, path), "json-objects")

    def parse(section: str, schema: T.StructType) -> DataFrame:
        broken = "_broken"
        whole = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
        parsed = F.from_json("object", whole, {"columnNameOfCorruptRecord": broken})
        rows = objects.where(F.col("section") == section).withColumn("o", parsed)
        failed = F.raise_error(F.concat(F.lit("cannot read an object of "), F.col("source"))).cast(whole.simpleString())
        rows = rows.withColumn("o", F.when(F.col("o").isNull() | F.col(f"o.{broken}").isNotNull(), failed).otherwise(F.col("o")))
        return rows.select("source", *[F.col(f"o.{f.name}") for f in schema.fields], "pos")

    return parse("images", KEYPOINT_IMAGE), parse("annotations", KEYPOINT_ANNOTATION)
