"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm import langid, mixing, near_texts, packing, quality
from kinetable.llm.common import id_crc, store, table

#: Narrow rows that a whole document weighs when tables are cut into files.
WIDE = 4


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score is at least 0.3, learned from all labels.

    Without any label every document stays.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    stats = quality.document_statistics(spark, F.col("text"))
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", stats.alias("stats"))
    model = quality.fit(known, labels)
    return docs.where(quality.score_text(spark, F.col("text"), model) >= quality.KEEP)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that one of the languages learned from ``lang`` accepts.

    Texts without a letter have no language and go.
    """
    calibrates = langid.for_calibration(id_crc())
    # Frequent n-grams grow more slowly than documents.
    model = langid.train(docs.where(~calibrates).select("lang", "text"), docs.count())
    measure = langid.measured(spark, F.col("text"), model)
    calibration = langid.calibrate(store(docs.where(calibrates).select("lang", measure.alias("m")), "calibration"), model)
    rows = docs.select(F.struct("*").alias("_doc"), measure.alias("m"))
    return langid.identified(rows, model, calibration).where("accepted").select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates.

    Near-duplicates share at least 0.8 of their five-word shingles.
    """
    return near_texts.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources draws them."""
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", mixing.word_count().alias("size"))
    return mixing.emitted(mixing.mix(rows, rows=WIDE * docs.count())).select("_doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    cut = store(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.pack(cut, count=docs.count())


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
#: Trained models and a tokenizer decide; no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
