"""Periodic runs of words by maximal-pair enumeration (operator 13).

A run is a stretch of words with smallest period q, at least 6 words and 4 periods long, that neither neighbour extends.
A text's suffixes are sorted by prefix doubling and their LCP-interval tree is walked bottom-up. A node holds its
suffixes' starts in one list for each word to their left. When a child joins a node, each start of the smaller side looks
up, in the other side's lists of different left words, the starts in reach: two such starts i < j are a maximal pair,
equal for exactly the node's number of words and no further on either side. A pair with distance d that is equal for
3 d words or more is the stretch from i to j's end with period d, whole as it stands; pairs of the same stretch differ in
d by multiples of the smallest one, which is kept.

The reach is a third of the node's depth, so nodes above three words hold no run: only suffixes whose first three
words occur again are sorted at all. Of a periodic stretch only its first start has another word to its left than the
starts after it, so the pairs met, like the lists moved (always the smaller), stay near the number of words.

Defined cases: null and empty texts, and those without words, have no run and collapse to nothing; short texts have no run;
a long text is taken whole, by one task, with some hundred bytes a word; repeated rows are treated each; a null doc_id
stays null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, with_long_ids

#: A run has so many words and so many periods at least.
WORDS, PERIODS = 6, 4
#: Hence its pairs are equal for so many words for each word of their distance, and for so many at least.
EQUAL = PERIODS - 1

Run = tuple[int, int, int]  # start, length, period


class Places:
    """Sorted starts that are cheap to extend at both ends."""

    __slots__ = ("high", "low")

    def __init__(self, first: int):
        self.high, self.low = [first], []

    def add(self, p: int) -> None:
        if p > self.high[0]:
            insort(self.high, p)
        else:
            insort(self.low, -p)

    def between(self, a: int, b: int) -> list[int]:
        found = self.high[bisect_left(self.high, a) : bisect_right(self.high, b)]
        return found + [-x for x in self.low[bisect_left(self.low, -b) : bisect_right(self.low, -a)]] if self.low else found


class Node:
    """An LCP interval: its starts by the word to their left."""

    __slots__ = ("lists", "starts")

    def __init__(self, p: int, left: int):
        self.starts, self.lists = {p}, {left: Places(p)}

    def add(self, p: int, left: int) -> None:
        self.starts.add(p)
        if left in self.lists:
            self.lists[left].add(p)
        else:
            self.lists[left] = Places(p)

    def others(self, p: int, left: int, reach: int, lefts: list[int]) -> Iterator[int]:
        """Starts within reach of p after another word than left: place by place if that is shorter than list by list."""
        if 2 * reach < len(self.lists):
            for q in range(p - reach, p + reach + 1):
                if q in self.starts and lefts[q] != left:
                    yield q
            return
        for word, places in self.lists.items():
            if word != left:
                yield from places.between(p - reach, p + reach)


def first_ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks of the suffixes by their first three words, -1 for the end; the starts whose three words occur again)."""
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(2, np.int64)])
    base = int(ids.max()) + 1
    pair = padded[:-1] * base + padded[1:]
    if base > 2_000_000:  # three words would not fit a number
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * base + padded[2:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[n] = -1
    return rank, order[~head | ~np.r_[head[1:], True]]


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts whose first three words occur again, sorted by suffix; whether each shares them with the one before it)."""
    rank, open_ = first_ranks(ids)
    first, every, size, step = rank.copy(), open_, len(ids) + 2, EQUAL
    while len(open_):
        key = rank[open_] * size + rank[open_ + step] + 1
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        old, at = rank[open_], np.arange(len(open_))
        head = np.r_[True, key[1:] != key[:-1]]
        group = np.r_[True, old[1:] != old[:-1]]
        rank[open_] = old + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        open_ = open_[~head | ~np.r_[head[1:], True]]
        step *= 2
    every = every[np.argsort(rank[every])]
    return every, np.r_[False, first[every[1:]] == first[every[:-1]]] if len(every) else np.zeros(0, bool)


def depths(words: list[int], order: list[int], linked: list[bool]) -> list[int]:
    """For each start in order, how many words it shares with the start before it: 0 if fewer than three."""
    before = {p: q for q, p, same in zip(order, order[1:], linked[1:], strict=False) if same}
    shared, last, h = {}, -2, 0
    for p in sorted(before):  # from one start to the next the number falls by one at most
        h = max(h - 1, EQUAL) if p == last + 1 else EQUAL
        q = before[p]
        while words[p + h] == words[q + h]:
            h += 1
        shared[p], last = h, p
    return [shared.get(p, 0) for p in order]


def word_runs(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers (from 1), by start, then period."""
    if len(ids) < WORDS:
        return []
    order, linked = suffix_order(ids)
    if not len(order):
        return []
    words = [*ids.tolist(), -1]
    lefts = [-2, *words[:-2]]
    order = order.tolist()
    found: dict[tuple[int, int], int] = {}

    def joined(a: Node | int, b: Node | int, depth: int) -> Node:
        """Child b joins a: their maximal pairs, then their union."""
        big, small = (b, a) if isinstance(a, int) or isinstance(b, Node) and len(b.starts) > len(a.starts) else (a, b)
        if isinstance(big, int):
            big = Node(big, lefts[big])
        reach = depth // EQUAL
        more = (small,) if isinstance(small, int) else small.starts
        for p in more:
            for q in big.others(p, lefts[p], reach, lefts):
                d = abs(p - q)
                if d + depth >= WORDS:
                    stretch = (min(p, q), max(p, q) + depth)
                    if d < found.get(stretch, d + 1):
                        found[stretch] = d
        for p in more:
            big.add(p, lefts[p])
        return big

    stack: list[tuple[int, Node | int]] = []
    at: Node | int = order[0]
    for p, depth in zip(order[1:], depths(words, order, linked.tolist())[1:], strict=True):
        while stack and stack[-1][0] >= depth:
            level, node = stack.pop()
            at = joined(node, at, level) if level >= EQUAL else at
        stack.append((depth, at))
        at = p
    while stack:
        level, node = stack.pop()
        at = joined(node, at, level) if level >= EQUAL else at
    return sorted((a, b - a, d) for (a, b), d in found.items())


def split(text: str) -> list[bytes]:
    """Words in UTF-8: white space is space and the characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").split()


def numbers(words: list[bytes]) -> np.ndarray:
    index = {w: k for k, w in enumerate(dict.fromkeys(words), 1)}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words but for all periods after the first of each run, joined by one space."""
    if found:
        stays = np.ones(len(words), bool)
        for start, length, period in found:
            stays[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(stays).tolist()]
    return b" ".join(words)


def looped(words: list[bytes], key: str | None) -> list[bytes]:
    """Words of every tenth document (by its id's crc32), from some place on, repeat a period: stretches to be found."""
    h, n = zlib.crc32(key.encode()) if key is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def texts(docs: DataFrame) -> DataFrame:
    return in_small_batches(docs).select(F.col("doc_id").cast("string").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))


def runs(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, runs (start, length, period in words) and the collapsed text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["_id"], pdf["_text"], strict=True):
                words = split(text)
                got = word_runs(numbers(words))
                rows.append((key, [dict(zip(("start", "length", "period"), r, strict=True)) for r in got], collapsed(words, got).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "runs", "collapsed"])

    return with_long_ids(texts(docs), find, "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def report(docs: DataFrame) -> DataFrame:
    """Per row: the runs of the words with loops put in: number, the one with most periods, digests of all and of what is left."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["_id"], pdf["_text"], strict=True):
                words = looped(split(text), key)
                got = word_runs(numbers(words))
                best = max(got, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                listed = "".join([f"{a},{b},{c}\n" for a, b, c in got]).encode()
                rows.append((key, len(got), *shown, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed(words, got)).hexdigest()))
            whole = ["n_runs", "start", "length", "period", "exponent_milli"]
            yield pd.DataFrame(rows, columns=["doc_id", *whole, "runs_sha256", "collapsed_sha256"]).astype(dict.fromkeys(whole, "Int64"))

    return with_long_ids(texts(docs), find, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
