import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64

from kinetable.llm import simhash
from kinetable.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """Smallest id by fingerprint, linked at two bits or fewer."""
    nodes = sorted(prints)
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for n in nodes:
        least[find(n)] += prints[n]
    return {n: min((d for d in least[find(n)] if d is not None), default=None) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_of_messy_texts(messy):
    out = simhash.with_fingerprint(messy.select("doc_id", "text")).collect()
    for r in out:
        if r["text"] is None or len(r["text"]) < 1000:
            assert r["fingerprint"] == signed(brute_print(r["text"]))


def test_near_pairs_equal_brute_force():
    random_ = np.random.default_rng(0)
    base = random_.integers(0, 2**64, 90, dtype=np.uint64)
    flips = base[:40] ^ (np.uint64(1) << random_.integers(0, 64, 40, dtype=np.uint64))
    a, b = np.concatenate([base, flips]), np.concatenate([flips, base[50:]])
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if bin(int(x ^ y)).count("1") <= 2}
    i, j = simhash.near_pairs(a, b, 2)
    assert set(zip(i.tolist(), j.tolist())) == want


def planted(count=160):
    random.seed(5)
    prints = defaultdict(list)
    doc = 0
    for _ in range(count):
        fp = random.getrandbits(64)
        for _ in range(random.randint(1, 6)):  # a chain of steps of one to three bits, with copies
            for _ in range(random.randint(1, 3)):
                prints[fp].append(doc if doc % 31 else None)
                doc += 1
            for bit in random.sample(range(64), random.randint(1, 3)):
                fp ^= 1 << bit
    for bit in range(40):  # a dense group around zero
        prints[1 << bit].append(10_000 + bit)
    prints[0].append(9_999)
    return prints


def test_classes_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "FANOUT", 3)
    prints = planted()
    rows = [(d, signed(fp), "other") for fp, docs in prints.items() for d in docs]
    df = spark.createDataFrame(rows, "doc_id long, fp long, component_id string")
    want = brute_classes(prints)
    out = simhash.near_classes(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["component_id"] == want[r["fp"] % (1 << 64)]


def test_links_do_not_grow_with_the_square_of_a_group(spark):
    df = spark.createDataFrame([(1 << b | 1 << c,) for b in range(40) for c in range(40)], "fp long").distinct()
    levels = simhash.index(df)
    assert simhash.links(levels).count() < df.count()


def test_components_of_chains_and_stars(spark):
    chain = [(k + 1, k) for k in range(100, 300)]
    star = [(1000, k) for k in range(1001, 1400)]
    out = components(spark.createDataFrame([*chain, *star, (5, 5), (7, 6)], "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in out}
    assert len(out) == len(got)
    assert got == {**{k: 100 for k in range(100, 301)}, **{k: 1000 for k in range(1000, 1400)}, 7: 6, 6: 6}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_keeps_the_smallest_id(messy, empty, small):
    kept = simhash.one_of_each(messy)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-5, 1, 3, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert simhash.one_of_each(empty).count() == 0
    prints = simhash.with_fingerprint(small, name="fp").select("doc_id", "fp")
    classes = simhash.near_classes(prints).agg(F.countDistinct("component_id")).first()[0]
    assert simhash.one_of_each(small).count() == classes
