import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.llm import resampling
from tests.llm.conftest import LONG, ROWS

BUCKETS = 10_000


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", lowered) if w]


def feats(text, run):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, run=1, buckets=BUCKETS, percent=10, fewest=20):
    def bucket(f):
        return crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, text in docs for f in feats(text, run))
    t = Counter(bucket(f) for text in target for f in feats(text, run))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        own = [bucket(f) for f in feats(text, run)]
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in own)
        weight = gain // len(own) if own else 0
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(own), weight, score, len(words_of(text)) >= fewest))
    eligible = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = eligible[: percent * len(eligible) // 100]
    return Counter((*r[:4], None) for r in out) - Counter((*r[:4], None) for r in drawn) + Counter((*r[:4], i) for i, r in enumerate(drawn, 1))


def resampled(spark, docs, target, **kw):
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("weight", "rank", "buckets", "_f", "n_words")})
    wanted = spark.createDataFrame([(t,) for t in target], "text string").withColumn("n_features", F.lit(1))
    found = resampling.resample(table, wanted, **kw).select("doc_id", "n_features", "weight", "score", "rank")
    return Counter(map(tuple, found.collect()))


@pytest.mark.parametrize("run, percent", [(1, 10), (3, 50)])
def test_equals_brute_force(spark, run, percent):
    docs = [(r[0], r[1]) for r in ROWS] + [(100 + i, f"Some WORDS {i % 7}, other_words; x{i} " * (1 + i % 9)) for i in range(80)]
    target = ["some words 3 other", None, "", "Zum Haus, über die Straße", LONG]
    assert resampled(spark, docs, target, run=run, percent=percent) == brute(docs, target, run, percent=percent)


def test_empty_tables(spark):
    assert not resampled(spark, [], ["x"])
    docs = [(i, "a b c " * 10) for i in range(30)]
    assert resampled(spark, docs, []) == brute(docs, [])
    assert not [r for r in resampled(spark, [(1, None), (2, "")], ["x"]) if r[1:3] != (0, 0) or r[4]]


def test_segments_give_the_features_of_the_whole_text(monkeypatch):
    text = "Ab, c_d  éf 12;" * 500 + "x" * 400 + " end"
    whole = [sorted(np.frombuffer(resampling.featured(text, resampling._Buckets(BUCKETS), run)[2], "<u2")) for run in (1, 2, 4)]
    monkeypatch.setattr(resampling, "SEGMENT", 37)
    for run, want in zip((1, 2, 4), whole, strict=True):
        words, count, found = resampling.featured(text, resampling._Buckets(BUCKETS), run)
        assert words == len(words_of(text)) and count == len(want)
        assert sorted(np.frombuffer(found, "<u2")) == want
