"""Token counts that follow edits: segment trees over pre-tokens, re-encoded only where touched."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm.common import small_batches

#: Pre-tokens in a leaf of a tree, and distinct pre-tokens whose counts a task remembers.
LEAF, REMEMBERED = 32, 200_000
EDIT = "struct<start:int,stop:int,text:string>"


class Counter:
    """Token counts of pre-tokens by a byte-level vocabulary."""

    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        with open(ranks_file, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens; together they are the text."""
        return self.pattern.findall(text)

    def counts(self, parts: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for part in set(parts).difference(self.known):
            self.known[part] = len(self.encoding.encode_ordinary(part))
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))


class Tree:
    """Segment tree over the leaves of one text. A leaf is a run of pre-tokens with its code
    points and tokens; an upper node is the sum of its two children.

    Level 0 of ``sums`` holds the leaves' (code points, tokens), the last level the whole text.
    """

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray):
        self.sums = [np.stack([sizes, tokens], axis=1).astype(np.int64) if len(sizes) else np.zeros((1, 2), np.int64)]
        while len(self.sums[-1]) > 1:
            self.sums.append(self._parents(self.sums[-1]))

    @staticmethod
    def _parents(level: np.ndarray) -> np.ndarray:
        return np.add.reduceat(level, np.arange(0, len(level), 2), axis=0)

    @property
    def tokens(self) -> int:
        return int(self.sums[-1][0, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds a code point, and where it starts; found from the root down."""
        node, start = 0, 0
        for level in reversed(self.sums[:-1]):
            node *= 2
            if node + 1 < len(level) and place >= start + level[node, 0]:
                start += int(level[node, 0])
                node += 1
        return node, start

    def replace(self, first: int, last: int, leaves: np.ndarray) -> None:
        """Puts new leaves in the place of first..last. With as many as before only the sums above
        them change, otherwise the levels from there to the right."""
        same = len(leaves) == last - first + 1
        level = self.sums[0]
        if same:
            level[first : last + 1] = leaves
        else:
            self.sums[0] = np.concatenate([level[:first], leaves, level[last + 1 :]]) if len(level) + len(leaves) > last - first + 1 else np.zeros((1, 2), np.int64)
        low, high = first, last
        for depth in range(1, len(self.sums) + 64):
            below = self.sums[depth - 1]
            if len(below) <= 1:
                del self.sums[depth:]
                return
            low, high = low // 2, high // 2
            size = (len(below) + 1) // 2
            if same and depth < len(self.sums):
                self.sums[depth][low : high + 1] = self._parents(below[2 * low : 2 * high + 2])
            else:
                kept = self.sums[depth][:low] if depth < len(self.sums) else np.zeros((0, 2), np.int64)
                kept = kept[:size]
                level = np.concatenate([kept, self._parents(below[2 * len(kept) :])]) if 2 * len(kept) < len(below) else kept
                self.sums[depth : depth + 1] = [level]


def _leaves(parts: list[str], counter: Counter) -> np.ndarray:
    if not parts:
        return np.zeros((0, 2), np.int64)
    cuts = np.arange(0, len(parts), LEAF)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.stack([np.add.reduceat(sizes, cuts), np.add.reduceat(counter.counts(parts), cuts)], axis=1)


def build(text: str, counter: Counter) -> Tree:
    leaves = _leaves(counter.split(text), counter)
    return Tree(leaves[:, 0], leaves[:, 1])


def edit(text: str, tree: Tree, edits: list[tuple[int, int, str]], counter: Counter) -> tuple[str, int]:
    """Applies edits (start, stop, new text) to the text and its tree.

    Edits are places in the old text; they are applied from the last to the first, so places
    before an edit stay valid. Each re-encodes the leaves it touches and one more on either
    side, and then goes on to the right, leaf by leaf, until a pre-token border of the new text
    falls on a border of the old leaves: from there on nothing can differ. Returns the new text and
    how many code points were encoded again.
    """
    again = 0
    for start, stop, new in sorted(edits, reverse=True):
        first, begin = tree.leaf_at(start)
        if first:
            first -= 1
            begin -= int(tree.sums[0][first, 0])
        last, at = tree.leaf_at(max(stop - 1, start))
        end = at + int(tree.sums[0][last, 0])
        text = text[:start] + new + text[stop:]
        shift = len(new) - (stop - start)
        count = len(tree.sums[0])
        while True:
            # One more leaf as context: its pre-tokens are only used if the border is clean.
            ahead = last + 1
            reach = end + (int(tree.sums[0][ahead, 0]) if ahead < count else 0)
            region = text[begin : reach + shift]
            again += len(region)
            parts = counter.split(region)
            if ahead >= count:
                break
            borders = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            clean = int(np.searchsorted(borders, end + shift - begin))
            if end + shift == begin or (clean < len(borders) and borders[clean] == end + shift - begin):
                parts = parts[: clean + 1] if end + shift > begin else []
                break
            last, end = ahead, reach
        tree.replace(first, last, _leaves(parts, counter))
    return text, again


def recounted(spark: SparkSession, text: Column, edits: Column, ranks_file: str, pattern: str) -> Column:
    """Struct of a whole text and its edits (array of ``start``, ``stop``, ``text``): ``tokens``
    before and ``edited_tokens`` after, ``n_edits``, ``chars`` and ``encoded_again`` code points,
    ``leaves`` of the tree afterwards.

    Edits must lie in the text and not overlap; others raise an error. Null texts and empty ones
    have no tokens, null edits are none.
    """
    small_batches(spark)
    kind = "struct<tokens:long,edited_tokens:long,n_edits:long,chars:long,encoded_again:long,leaves:long>"

    @F.pandas_udf(kind)
    def recount(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        counter = Counter(ranks_file, pattern)
        for texts, changes in batches:
            rows = []
            for old, wanted in zip(texts, changes, strict=True):
                old = old or ""
                own = [(int(e["start"]), int(e["stop"]), e["text"] or "") for e in (wanted if wanted is not None else [])]
                own.sort()
                if any(not 0 <= a <= b <= len(old) for a, b, _ in own) or any(x[1] > y[0] for x, y in zip(own, own[1:], strict=False)):
                    raise ValueError("edits overlap or lie outside their text")
                tree = build(old, counter)
                before = tree.tokens
                _, again = edit(old, tree, own, counter)
                rows.append((before, tree.tokens, len(own), len(old), again, len(tree.sums[0])))
            yield pd.DataFrame(rows, columns=["tokens", "edited_tokens", "n_edits", "chars", "encoded_again", "leaves"])

    return recount(text, edits)


def matches(text: Column, pattern: str, new: str) -> Column:
    """Edits that put ``new`` in the place of each match of a pattern."""

    @F.pandas_udf(f"array<{EDIT}>")
    def found(texts: pd.Series) -> pd.Series:
        compiled = regex.compile(pattern)
        return pd.Series([[{"start": m.start(), "stop": m.end(), "text": new} for m in compiled.finditer(t or "")] for t in texts])

    return found(text)
