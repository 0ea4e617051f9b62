from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from kinetable.llm import filter_audit

WORDY = " ".join(f"word{i}" for i in range(60))
SHOUT = " ".join(f"WORD{i}" for i in range(60)) + " $"


def brute(docs, labels):
    """Rows of the audit by walking every document through every order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for doc_id, _, text in docs:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    out, shapley = defaultdict(lambda: [0] * 6), Counter()
    for doc_id, source, text in docs:
        text, part = text or "", source or ""
        words = text.encode().split()
        failed = "".join(
            letter
            for letter, fails in zip(
                "ABCDE",
                (
                    len(words) < 50,
                    100 * len(set(words)) < 65 * len(words),
                    100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                    any(c in "#$%&*|" for c in text),
                    doc_id is not None and smallest[text] < doc_id,
                ),
                strict=True,
            )
            if fails
        )
        for order in permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                row, fails = out[part, "".join(order), step], letter in failed
                here = fails and not gone
                row[0] += not gone and not fails
                row[1] += here
                row[2] += fails and gone
                row[3] += failed == letter
                row[4] += here and doc_id in good
                row[5] += here and doc_id in toxic
                shapley[part, letter] += here
                gone |= fails
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    table = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in ("part", "mask", "n", "digest", "f")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("y") for c in ("good", "_name")})
    return [tuple(r) for r in filter_audit.audit(table, marks).collect()]


def test_equals_brute_force(spark):
    texts = [None, "", WORDY, SHOUT, WORDY + " |", "same word " * 30, "one", "x\x00 é " * 40, "A" * 3000]
    docs = [(i, ("a", "b", None, "")[i % 4], texts[i * 5 % len(texts)]) for i in range(60)]
    docs += [(3, "b", WORDY), (3, "b", WORDY), (3, "a", WORDY), (None, "a", WORDY), (None, None, None), (-7, "c", "one")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 40)] + [(None, 1, 1), (2, 1, None), (500, 1, 1)]
    found = audited(spark, docs, labels)
    assert len(found) == len(set(found)) == 4 * 600
    assert set(found) == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == []
    assert {r[3:] for r in audited(spark, [(1, "a", WORDY)], [])} == {(1, 0, 0, 0, 0, 0, 0)}


def test_fields_do_not_run_over():
    """Fields stand apart up to the stated number of documents."""
    many = (1 << 57) - 1
    steps, taken = filter_audit.unpacked(many * filter_audit.packed(31, True, True))
    assert set(steps[:, 1].tolist()) == {0, many}
    assert (taken == 24 * many).all()


@pytest.mark.parametrize("text", [WORDY * 700, "word " * 90_000 + "end"])
def test_long_texts_are_counted_whole(text, monkeypatch):
    whole = filter_audit.text_failures(text)
    monkeypatch.setattr(filter_audit, "SEGMENT", 100)
    assert filter_audit.text_failures(text) == whole
    words = text.split()
    assert bool(whole[0] & 2) == (100 * len(set(words)) < 65 * len(words))
