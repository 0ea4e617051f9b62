import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kinetable.llm import packing
from kinetable.llm.common import store

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "a", " lead  trail ", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "J̌abc J̌ T̈ é́",
    "'surprise 'tis don't DON'T it's, ''s 's' ('re) x' (('tis -'s '", "ÀÉÎ Straße ẞ İstanbul ΣΑΣ ǅ ŉ Ĳ 5ºª µ",
    "12,3.4 a1b2 foo_bar __x__ a.b.c ...end... \"quoted\"", "日本語 テスト 😀😀  nbsp em \x1c\x1d\x85next",
    "\x00ctl \x7f", "ſ K Å ﬁ ﬀ", "a" * 5000, "ab " * 3000, "l'eau d'été L'État", "naïve​zero \\ ] ^ - [x] {y}",
]


def test_ids_equal_those_of_the_tokenizer(small):
    plain = Tokenizer.from_file(FILE)
    texts = ODD + [r["text"] for r in small.collect()]
    for text, ids in zip(texts, packing.WordIds(FILE)(pa.array(texts)), strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def check_places(rows, capacity):
    """Every sequence is filled from 0 without gaps and not over its capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places(small):
    plain = Tokenizer.from_file(FILE)
    rows = packing.pack(store(packing.pieces(small, FILE), "pieces")).collect()
    want = Counter()
    for r in small.collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r["doc_id"], piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    used = check_places(rows, 4096)
    assert used <= -(-sum(r["length"] for r in rows) // 4096) * 1.02 + 1


def test_messy_and_empty(messy, empty):
    cut = store(packing.pieces(messy, FILE), "pieces")
    rows = packing.pack(cut).collect()
    assert len(rows) == cut.count() and check_places(rows, 4096)
    assert sorted(r["length"] for r in rows if r["doc_id"] in (3, 4, 5)) == [1, 1, 1]
    assert packing.pack(store(packing.pieces(empty, FILE), "pieces")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_rank_once(seed):
    random = np.random.default_rng(seed)
    lengths = np.unique(random.integers(1, 4097, 60 if seed else 1))
    counts = random.integers(1, 400, len(lengths))
    plan = packing.plan(lengths, counts)
    rows = []
    for length, n in zip(lengths, counts, strict=True):
        sequence, offset = packing.place(plan, np.full(n, length), np.arange(n))
        rows += [{"sequence_id": s, "offset": o, "length": length} for s, o in zip(sequence, offset, strict=True)]
    used = check_places(rows, 4096)
    # First fit of the lengths in falling order, item by item.
    bins = []
    for length in sorted((r["length"] for r in rows), reverse=True):
        fits = [k for k, gap in enumerate(bins) if gap >= length]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= length
        else:
            bins.append(4096 - length)
    assert used <= len(bins) * 1.02 + 1


def test_hot_length(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, 700L, 1 + id % 999) as length", "'x' as offset")
    assert check_places(packing.pack(store(df, "hot")).collect(), 4096)
