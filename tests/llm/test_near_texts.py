import random

import pytest

import corpus_pipeline
from kinetable.llm import near_texts

from .conftest import SF


def brute(rows):
    """Smallest id of each class linked at a Jaccard similarity of 0.8 of five-word shingles."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {min(d for (d, _), x in zip(rows, label, strict=True) if x == c) for c in set(label)}


def planted():
    """Chains of copies with a few words changed, on both sides of the similarity, and short texts."""
    random.seed(3)
    word = lambda: f"w{random.randrange(5000)}"
    texts = []
    for _ in range(25):
        words = [word() for _ in range(random.randint(30, 160))]
        for _ in range(random.randint(1, 8)):
            texts.append(" ".join(words))
            for _ in range(random.randint(1, 4)):
                words[random.randrange(len(words))] = word()
    texts += ["", " ", "one", "One", "one two", "a b c d e", "a b c d e f"]
    random.shuffle(texts)
    return list(enumerate(texts))


def test_stage_keeps_one_of_each_class(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(brute(rows))


@pytest.mark.parametrize("limit, value", [("BLOCK", 3), ("BLOCK_SHINGLES", 150)])
def test_every_bucket_is_compared_without_leaders(spark, monkeypatch, limit, value):
    monkeypatch.setattr(near_texts, "LEADERS", 0)
    monkeypatch.setattr(near_texts, limit, value)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_texts.one_of_each(docs).collect()) == sorted(brute(rows))


def test_recall_on_the_sample_corpus(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert {r["doc_id"] for r in near_texts.one_of_each(small).collect()} == brute(rows)


def test_messy_and_empty(messy, empty):
    kept = near_texts.one_of_each(messy)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-5, 1, 3, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert near_texts.one_of_each(empty).count() == 0


def test_candidates_come_from_the_gray_index(spark):
    """Without any band, all sets whose fingerprints are within two bits and that are similar still link."""
    from kinetable.llm.simhash import RADIUS, majority

    texts = [" ".join(f"w{k}_{i}" for i in range(400)) for k in range(6)]
    texts = [f"{t} {tail}" for t in texts for tail in ("", "one", "two")]
    sets = {near_texts.sketch(s)[0]: s for s in map(near_texts.shingles, texts)}
    fps = {k: majority(s) for k, s in sets.items()}
    close = {(a, b) for a in sets for b in sets if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= RADIUS}
    near = {(a, b) for a, b in close if near_texts.enough(len(set(sets[a]) & set(sets[b])), len(sets[a]), len(sets[b]))}
    assert len(near) >= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    classes = docs.select("_row", near_texts._sketches("text").alias("s")).select("_row", "s.key", "s.size", "s.fp")
    bare = classes.selectExpr("*", "cast(array() AS array<bigint>) AS bands")
    found = {(r["u"], r["v"]) for r in near_texts.links(bare, docs).collect()}
    label = {k: k for k in sets}
    for _ in sets:
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    assert found <= near and all(label[a] == label[b] for a, b in near)
