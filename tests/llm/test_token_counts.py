import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kinetable.llm import token_counts
from kinetable.llm.token_counts import Counter, Tree, build, edit

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def counter():
    return Counter(FILE, PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 32])
def test_edited_counts_equal_counting_again(counter, small, monkeypatch, leaf):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    random.seed(leaf)
    texts = [r["text"] for r in small.limit(60).collect()] + ["", "a", " ", "   \n  x  ", "it's 'twas  don''t   \n\n  12 ab" * 5]
    new = ["", " ", "x", "  ", "'s", "\n\n ", "hello wor", "12 ", "é", "   "]
    for text in texts:
        for _ in range(3):
            places = sorted(random.randint(0, len(text)) for _ in range(2 * random.randint(0, 6)))
            edits = [(a, min(b, a + random.choice([0, 1, 3, 30])), random.choice(new)) for a, b in zip(places[::2], places[1::2], strict=True)]
            tree = build(text, counter)
            got, _ = edit(text, tree, edits, counter)
            want = text
            for a, b, s in sorted(edits, reverse=True):
                want = want[:a] + s + want[b:]
            assert got == want
            assert tree.tokens == len(counter.encoding.encode_ordinary(want))
            assert tree.sums[-1].tolist() == [[len(want), tree.tokens]]
            for below, above in zip(tree.sums, tree.sums[1:], strict=False):
                assert np.array_equal(Tree._parents(below), above)


def test_one_edit_encodes_little(counter):
    text = "Some words of a long text, again and again. " * 3000
    tree = build(text, counter)
    _, again = edit(text, tree, [(len(text) // 2, len(text) // 2 + 3, "changed")], counter)
    assert again < len(text) / 50


def test_messy_and_empty(messy, empty, counter):
    spark = messy.sparkSession

    def rows(docs):
        docs = docs.withColumn("edits", token_counts.matches(F.col("text"), r"\d+|fox", "<x>"))
        return docs.select("text", token_counts.recounted(spark, F.col("text"), F.col("edits"), FILE, PATTERN).alias("c")).select("text", "c.*")

    import re

    for r in rows(messy).collect():
        text = r["text"] or ""
        assert r["tokens"] == len(counter.encoding.encode_ordinary(text))
        assert r["edited_tokens"] == len(counter.encoding.encode_ordinary(re.sub(r"\d+|fox", "<x>", text)))
        assert r["chars"] == len(text)
    assert rows(empty).count() == 0
    none = messy.withColumn("edits", F.lit(None).cast("array<" + token_counts.EDIT + ">"))
    out = none.select(token_counts.recounted(spark, F.col("text"), F.col("edits"), FILE, PATTERN).alias("c")).select("c.*").collect()
    assert all(r["tokens"] == r["edited_tokens"] and r["n_edits"] == 0 for r in out)


def test_overlapping_edits_raise(spark):
    df = spark.createDataFrame([("abcdef", [(0, 3, "x"), (2, 4, "y")])], "text string, edits array<" + token_counts.EDIT + ">")
    with pytest.raises(Exception, match="overlap"):
        df.select(token_counts.recounted(spark, F.col("text"), F.col("edits"), FILE, PATTERN)).collect()
