import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__  # noqa: F401  (sends the package to the workers)

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves; documents may have such columns too.
CLASHING = (
    "size copies target weight source_size shard slot fp fingerprint component_id node root row_no m stats label "
    "score predicted accepted lang_pred piece start length offset sequence_id edits held_out key u v"
).split()
LONG = "Ein sehr langer Text, immer weiter. " * 30_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (2, "the QUICK brown fox jumps over the lazy dog.", "en", "a", 44),
    (3, None, "en", "a", None),
    (4, "", None, "b", 0),
    (5, " \t\n ", "de", "b", 4),
    (None, "A text without an id, at least of some length.", "en", None, 46),
    (6, "12345 !!! ###", None, None, 13),
    (7, LONG, "de", "c", len(LONG)),
    (8, "Null\x00 byte, 日本語 and 😀 emojí; <|endoftext|>   x", None, "", 40),
    (9, "one", "en", "b", 3),
    (10, "one two", "fr", "b", 7),
    (-5, "Der Hund läuft über die Straße zum Haus.", "de", "c", 40),
]
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, odd texts, repeated rows and clashing columns."""
    df = spark.createDataFrame(ROWS, DOCUMENTS)
    return df.withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
