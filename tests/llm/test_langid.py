import numpy as np
from pyspark.sql import functions as F

from kinetable.llm import langid
from kinetable.llm.common import id_crc


def trained(docs):
    calibrates = langid.for_calibration(id_crc())
    model = langid.train(docs.where(~calibrates))
    measured = docs.withColumn("m", langid.measured(docs.sparkSession, F.col("text"), model))
    return model, measured, langid.calibrate(measured.where(calibrates), model)


def test_grams_of_words():
    letters = langid._letters()
    key, doc = langid.grams(["Ab, c", None, "", "7!", "é"], letters)
    parts = [[int(k) >> s & 0xFFFF for s in (48, 32, 16, 0)] for k in key]
    a, b, c, e = map(ord, "abcé")
    assert parts == [[0, 0, 0, a], [0, 0, a, b], [0, a, b, 0], [a, b, 0, c], [0, 0, 0, e]]
    assert doc.tolist() == [0, 0, 0, 0, 4]


def test_costs_equal_kneser_ney_by_hand(spark):
    docs = spark.createDataFrame([("x", "abab ab"), ("x", "ba"), ("y", "cc")], "lang string, text string")
    model = langid.train(docs)
    letters = langid._letters()
    keys, _ = langid.grams(["abab ab", "ba"], letters)
    grams = [tuple(int(k) >> s & 0xFFFF for s in (48, 32, 16, 0)) for k in keys]

    def probability(gram):
        """By the definition, from the list of 4-grams alone."""
        p = 1.0 / (model.letters + 1)
        for order in range(1, 5):
            if order == 4:
                bag = list(grams)
            else:
                bag = list(grams)
                for lower in range(3, order - 1, -1):
                    bag = [g[1:] for g in set(bag)]
            counts = {g: bag.count(g) for g in set(bag)}
            ones, twos = (sum(v == n for v in counts.values()) for n in (1, 2))
            d = min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5
            part = gram[4 - order :]
            same = {g: n for g, n in counts.items() if g[:-1] == part[:-1]}
            if same:
                total = sum(same.values())
                p = (max(counts.get(part, 0) - d, 0) + d * len(same) * p) / total
        return p

    asked, _ = langid.grams(["abba cab"], letters)
    got = langid.costs(tuple(model), asked)[model.languages.index("x")]
    want = [-np.log(probability(tuple(int(k) >> s & 0xFFFF for s in (48, 32, 16, 0)))) for k in asked]
    assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", id_crc() % 4 == 2)
    model, _, calibration = trained(docs.where(~F.col("held_out")))
    rows = docs.where("held_out").withColumn("m", langid.measured(spark, F.col("text"), model))
    out = langid.identified(rows, model, calibration).collect()
    assert len(out) > 200
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97
    assert np.mean([r["accepted"] for r in out]) > 0.98
    noise = spark.createDataFrame([("zqxj kvwq xzzq qqkx jjqz wvvq " * 30,)], "text string")
    strange = langid.identified(noise.withColumn("m", langid.measured(spark, F.col("text"), model)), model, calibration).first()
    assert not strange["accepted"]


def test_messy_and_empty(messy, empty):
    model, measured, calibration = trained(messy)
    out = langid.identified(measured, model, calibration).collect()
    assert len(out) == messy.count()
    for r in out:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered)
        assert 0 <= r["score"] <= 1 and (lettered or (r["score"] == 0 and not r["accepted"]))
    model, measured, calibration = trained(empty)
    assert langid.identified(measured, model, calibration).count() == 0
    rows = messy.withColumn("m", langid.measured(messy.sparkSession, F.col("text"), model))
    assert {r["lang_pred"] for r in langid.identified(rows, model, calibration).collect()} == {"und"}


def test_segments_cover_long_texts(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 7)
    texts = ["abc", None, "0123456789abcdefgh", "", "xy"]
    whole = {}
    for owners, parts in langid.segments(texts):
        for k, part in zip(owners.tolist(), parts, strict=True):
            whole[k] = whole.get(k, "") + part
    assert whole == {k: t for k, t in enumerate(texts) if t}
