"""Best-fit packing: a configuration linear program over the histogram of lengths, rounded."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import numbered, small_batches, store

CAPACITY, END_ID = 4096, 1
#: Rounds of the weights, and how fast a price falls with what its length got too much.
ROUNDS, STEP = 100, 0.1
#: Documents whose ids are laid out at a time.
LOT = 500
#: Bytes of documents whose words are looked up together.
BATCH = 3_000_000
#: ASCII marks that are neither letters, digits nor white space.
MARKS = "".join(chr(x) for x in range(0x21, 0x7F) if not chr(x).isalnum())
#: Letters up to U+024F with one lower-case form, no combining marks.
LATIN = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+$"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones stay themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that ``index`` names, one after the other."""
    n = sizes[index]
    before = np.cumsum(n) - n
    return flat[np.arange(int(n.sum())) + np.repeat(starts[index] - before, n)]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class WordIds:
    """Ids of whole texts by a tokenizer that lower-cases and drops white space.

    Its tokens never reach over white space, so each distinct word of a batch is encoded once.
    Words are cut at ASCII white space only; any other stays inside for the tokenizer to see.
    A word of Latin letters between marks falls into those three parts for the tokenizer too:
    its letters go straight to the vocabulary, many at a time, each ending in a word-end token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same vocabulary without the steps that bare letters do not need.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.bytes_as = _byte_letters()

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of each text."""
        ids = self._encoded(self.tokenizer, texts, 300)
        return np.concatenate([np.empty(0, np.int64), *ids]), np.array([len(x) for x in ids], np.int64)

    @staticmethod
    def _encoded(tokenizer, texts: list[str], lot: int) -> list[np.ndarray]:
        """Ids of each text, a few at a time: what the tokenizer returns is large beside them."""
        found = []
        for at in range(0, len(texts), lot):
            encoded = tokenizer.encode_batch_fast(texts[at : at + lot], add_special_tokens=False)
            found += [np.array(e.ids, np.int64) for e in encoded]
        return found

    def spelled(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of lower-case Latin letters alone."""
        cores = [c if c.isascii() else c.encode().decode("latin-1").translate(self.bytes_as) for c in cores]
        lines = [" ".join(cores[at : at + 1000]) for at in range(0, len(cores), 1000)]
        ids = np.concatenate([np.empty(0, np.int64), *self._encoded(self.letters, lines, 3)])
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(cores):
            raise ValueError("a word does not end in one word-end token")
        return ids, sizes

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct words."""
        inner = pc.utf8_ltrim(words, MARKS)
        core = pc.utf8_rtrim(inner, MARKS)
        width = [pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (words, inner, core)]
        head, tail = width[0] - width[1], width[1] - width[2]
        latin = pc.match_substring_regex(core, LATIN).to_numpy(zero_copy_only=False)
        # An apostrophe before letters may be the start of a contraction.
        latin &= ~pc.match_substring_regex(words, f"^[{re.escape(MARKS)}]*'[A-Za-z]").to_numpy(zero_copy_only=False)
        lowered = pc.dictionary_encode(pc.utf8_lower(core.filter(pa.array(latin))))
        spelled = self.spelled(lowered.dictionary.to_pylist())
        # Units: the empty one, spelled cores, marks, and words that only the tokenizer can take apart.
        marked = np.flatnonzero(latin & ((head > 0) | (tail > 0)))
        sides: dict[str, int] = {}
        ends = np.zeros((len(words), 2), np.int64)
        for at, word, h, t in zip(marked, words.take(pa.array(marked)).to_pylist(), head[marked], tail[marked], strict=True):
            if h:
                ends[at, 0] = sides.setdefault(word[:h], len(sides) + 1)
            if t:
                ends[at, 1] = sides.setdefault(word[-t:], len(sides) + 1)
        others = words.filter(pa.array(~latin)).to_pylist()
        rest = self.whole([*sides, *others])
        ids = np.concatenate([spelled[0], rest[0]])
        sizes = np.concatenate([[0], spelled[1], rest[1]])
        known = len(spelled[1])
        units = np.zeros((len(words), 3), np.int64)
        units[:, 0::2] = np.where(ends > 0, ends + known, 0)
        units[latin, 1] = lowered.indices.to_numpy(zero_copy_only=False) + 1
        units[~latin, 1] = known + len(sides) + 1 + np.arange(len(others))
        return gathered(ids, _starts(sizes), sizes, units.ravel()), sizes[units].sum(axis=1)

    def __call__(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """Ids of each text; a null has none."""
        texts = pc.fill_null(texts, "")
        # A special token's name, or a mark that may join the letter before it, needs the tokenizer.
        odd = pc.match_substring_regex(texts, r"<\||[\x{300}-\x{36f}]").to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(odd), "", texts)))
        offsets = lists.offsets.to_numpy()
        coded = pc.dictionary_encode(lists.values)
        ids, sizes = self.words(coded.dictionary)
        starts, index = _starts(sizes), coded.indices.to_numpy(zero_copy_only=False)
        for at in range(0, len(texts), LOT):
            last = min(at + LOT, len(texts))
            part = index[offsets[at] : offsets[last]]
            flat = gathered(ids, starts, sizes, part)
            ends = np.concatenate([[0], np.cumsum(sizes[part])])[offsets[at : last + 1] - offsets[at]]
            for k in range(at, last):
                if odd[k]:
                    yield self.whole([texts[k].as_py()])[0]
                else:
                    yield flat[ends[k - at] : ends[k - at + 1]]


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Both columns of the batches, put together to lots of about BATCH bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH:
            yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """(``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``) of every document.

    A document's ids end with the id 1, so a null or empty text is a piece of that one id. Only
    documents of more ids than ``capacity`` are cut, each piece but the last to that length.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(tokenizer_file)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for docs_, texts in _lots(batches):
            rows = []
            for doc, ids in zip(docs_.to_pylist(), ids_of(texts), strict=True):
                data = np.append(ids, END_ID).astype("<u4").tobytes()
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of every room up to the capacity, and the length that
    its pattern takes first (-1: leave one place empty)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = upto[c]
        gain = best[c - lengths[:k]] + values[:k]
        i = k - 1 - int(gain[::-1].argmax())  # of equal gains the longest
        if gain[i] > best[c - 1] + 1e-12:
            best[c], choice[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    return best, choice


def _pattern(first: int, lengths: np.ndarray, choice: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The best sequence that holds a given length, as (length's index, times)."""
    counts, room = {first: 1}, capacity - int(lengths[first])
    while room > 0:
        i = int(choice[room])
        if i < 0:
            room -= 1
        else:
            counts[i] = counts.get(i, 0) + 1
            room -= int(lengths[i])
    return tuple(sorted(counts.items()))


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple, float]:
    """Patterns with how often to use each: the configuration program by multiplicative weights.

    Every round prices the lengths, takes for each length that is still short the most valuable
    sequence holding it, and covers the whole demand. A length that got more than its demand
    becomes cheaper by a factor, so later rounds fill up with others; the mean of all rounds covers
    the demand. A price starts at the size, at which any full sequence is optimal.
    """
    price, used = lengths / capacity, {}
    for _ in range(ROUNDS):
        _, choice = _price(lengths, price, capacity)
        left = counts.astype(float)
        for i in range(len(lengths) - 1, -1, -1):
            if left[i] <= 0:
                continue
            pattern = _pattern(i, lengths, choice, capacity)
            times = left[i] / dict(pattern)[i]
            used[pattern] = used.get(pattern, 0.0) + times / ROUNDS
            for k, n in pattern:
                left[k] -= times * n
        price = price * np.exp(-STEP * np.minimum(-left / counts, 4.0))
    return used


class Plan(NamedTuple):
    """Runs of equal sequences: for each length of a run the first rank it takes, how many a
    sequence holds, the run's first sequence and where the length begins inside it."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def place(plan: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces from their length and their rank among those of it."""
    lengths, first, each, sequence, offset = plan
    at = np.searchsorted((lengths << 48) + first, (length << 48) + rank, side="right") - 1
    inside = rank - first[at]
    return sequence[at] + inside // each[at], offset[at] + inside % each[at] * length


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Whole patterns of the program first, then best fit for what rounding leaves.

    Works on the histogram alone: its size is bounded by the capacity, whatever the rows.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    left, runs = counts.copy(), []
    program = fractional(lengths, counts, capacity) if len(lengths) else {}
    for pattern, times in sorted(program.items(), key=lambda x: (-x[1], x[0])):
        used, each = np.array(pattern).T
        whole = min(int(times + 1e-9), int((left[used] // each).min()))
        if whole:
            runs.append((whole, used, each))
            left[used] -= whole * each
    while left.any():
        gap, used, each = capacity, [], []
        there = np.flatnonzero(left)
        while len(there := there[lengths[there] <= gap]):
            i = int(there[-1])
            k = int(min(left[i], gap // lengths[i]))
            used.append(i)
            each.append(k)
            gap -= k * int(lengths[i])
            there = there[:-1]
        used_, each_ = np.array(used), np.array(each)
        whole = int((left[used_] // each_).min())
        runs.append((whole, used_, each_))
        left[used_] -= whole * each_
    rows, taken, sequence = [], np.zeros(len(lengths), np.int64), 0
    for whole, used, each in runs:
        offset = 0
        for i, k in zip(used.tolist(), each.tolist(), strict=True):
            rows.append((lengths[i], taken[i], k, sequence, offset))
            taken[i] += whole * k
            offset += k * lengths[i]
        sequence += whole
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns)


def pack(cut: DataFrame, capacity: int = CAPACITY, count: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces: places without gaps from 0.

    Pieces of a length are ranked by id and piece, whatever their number, and a rank finds its
    place in the plan by arithmetic. Repeated rows are packed each on its own; an empty table
    gives an empty one. ``count`` is the ``rows`` of :func:`kinetable.llm.common.store`.
    """
    spark = cut.sparkSession
    cut = cut.drop("sequence_id", "offset")
    rows = numbered(cut, [F.col(c).asc() for c in ("length", "doc_id", "piece")], "pieces", "_pack_row", count)
    # At most one row per length up to the capacity.
    histogram = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").toPandas()
    lengths, counts = histogram["length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    shared = spark.sparkContext.broadcast((tuple(plan(lengths, counts, capacity)), lengths, starts))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, row: pd.Series) -> pd.DataFrame:
        layout, known, first = shared.value
        size, at = length.to_numpy(np.int64), row.to_numpy(np.int64)
        sequence, offset = place(layout, size, at - first[np.searchsorted(known, size)])
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return rows.withColumn("_placed", placed("length", "_pack_row")).select(
        *cut.columns, "_placed.sequence_id", "_placed.offset"
    )
