"""Byte-level BPE encoding and decoding as a tree reduction over a monoid (operator 12).

Encodings under `join` form a monoid: join(encode(a), encode(b)) = encode(a + b). So a pre-token is encoded by halves, and
neighbours are joined by re-encoding a window of tokens on both sides of the boundary, from one token a side upwards.

Why a window may end the growth: a token sequence is the encoding of its bytes exactly if each two adjacent tokens are
(merges happen in the order of their ranks, and a pair made by a merge ranks behind it, so the first merge that would
cross from one token to the next depends on these two alone). If the window's new encoding begins with the token that
it began with, the pair at its left edge is one of the left half's pairs, which hold already; likewise on the right.
Then every adjacent pair of the result holds, whatever lies outside. A window that has swallowed a side needs no
condition there. `checked` tests what this rests on: each token's own encoding is the token, and its two last parts
rank before it.

Texts are cut into pre-tokens by the public pattern; equal chunks between spaces come from a cache that is bounded in
bytes. Decoding maps ids to bytes and concatenates halves up the tree.

Defined cases: null text is empty, with no ids; white space and long words are pre-tokens like others; a long text goes
through in parts that are cut where a pre-token must start; repeated rows are encoded each; null ids stay null; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, in_small_batches, with_long_ids
from .tokens import CUT

#: The pattern's classes and the pattern, with a place for letters and digits.
CLASSES = (r"\p{L}", r"\p{N}")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[LETTER]+| ?[DIGIT]+| ?[^\s[LETTER][DIGIT]]+|\s+(?!\S)|\s+"

#: A longer text is cut into pre-tokens piece by piece; a longer chunk is never cached.
LONG_TEXT, LONG_CHUNK = 1_000_000, 200
#: Bytes of a worker's caches.
CHUNK_BYTES, PART_BYTES = 200 << 20, 48 << 20
#: Longer byte strings are merged by a heap; parts of a word up to so long are cached.
SHORT, PART = 48, 8


def ranges(codes: np.ndarray) -> str:
    """Code points as ranges of a character class."""
    ends = np.flatnonzero(np.diff(codes) > 1)
    first, last = codes[np.r_[0, ends + 1]], codes[np.r_[ends, len(codes) - 1]]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


@lru_cache(maxsize=1)
def exact_pattern() -> tuple[regex.Pattern, regex.Pattern]:
    """(characters that this machine's two pattern libraries class differently, the pattern by the tokenizer's own classes):
    both follow Unicode, but not the same version of it."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    own, odd = [], []
    for name in CLASSES:
        finder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(finder.encode_ordinary(every)).decode()
        own.append(np.sort(np.frombuffer(found.encode("utf-32-le"), "<u4").astype(int)))
        odd += map(ord, {*found} ^ {*regex.findall(name, every)})
    pattern = PATTERN.replace("[LETTER]", f"[{ranges(own[0])}]").replace("[DIGIT]", f"[{ranges(own[1])}]")
    strange = regex.compile(f"[{ranges(np.unique(odd))}]") if odd else regex.compile("(?!)")
    return strange, regex.compile(pattern, regex.V1)


PLAIN = regex.compile(PATTERN.replace("[LETTER]", r"[\p{L}]").replace("[DIGIT]", r"[\p{N}]"), regex.V1)


def pattern_for(text: str) -> regex.Pattern:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        strange, exact = exact_pattern()
        return exact if strange.search(text) else PLAIN
    return PLAIN


def packed(ids: list[int] | tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TreeBpe:
    """Ids of pre-tokens by halves, of texts by chunks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.spelled = [b""] * (max(self.rank.values()) + 1)
        for word, i in self.rank.items():
            self.spelled[i] = word
        self.parts, self.windows, self.chunks = Cache(PART_BYTES), Cache(PART_BYTES), Cache(CHUNK_BYTES)

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """The definition: merge the adjacent pair of lowest rank, the leftmost of equals, until there is none."""
        rank, none = self.rank.get, len(self.spelled)
        sym = [raw[k : k + 1] for k in range(len(raw))]
        if len(raw) > SHORT:
            return self.merged_long(sym)
        pairs = [rank(raw[k : k + 2], none) for k in range(len(raw) - 1)]
        while pairs and (low := min(pairs)) < none:
            k = pairs.index(low)
            sym[k] += sym.pop(k + 1)
            del pairs[k]
            if k < len(pairs):
                pairs[k] = rank(sym[k] + sym[k + 1], none)
            if k:
                pairs[k - 1] = rank(sym[k - 1] + sym[k], none)
        return tuple([self.rank[s] for s in sym])

    def merged_long(self, sym: list[bytes]) -> tuple[int, ...]:
        """The same by a heap of the pairs."""
        nxt, prv, heap, size = [*range(1, len(sym) + 1)], [*range(-1, len(sym) - 1)], [], len(sym)

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < size and (r := self.rank.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (r, a, b))

        for k in range(size - 1):
            offer(k, k + 1)
        while heap:
            r, a, b = heapq.heappop(heap)
            if not sym[a] or not sym[b] or nxt[a] != b or self.rank.get(sym[a] + sym[b]) != r:
                continue
            sym[a], sym[b] = sym[a] + sym[b], b""
            nxt[a] = nxt[b]
            if nxt[b] < size:
                prv[nxt[b]] = a
            offer(prv[a], a)
            offer(a, nxt[a])
        return tuple([self.rank[s] for s in sym if s])

    def window(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of left and right together; short windows come from a cache."""
        found = self.windows.get((left, right))
        if found is None:
            found = self.merged(self.decoded(left) + self.decoded(right))
            if len(left) + len(right) <= 6:
                self.windows.keep((left, right), found, 120 + 8 * (len(left) + len(right) + len(found)))
        return found

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's product: windows grow on each side that has not settled, by doubling."""
        i, j = len(a) - 1, 1
        while True:
            got = self.window(a[i:], b[:j])
            left, right = i == 0 or got[0] == a[i], j == len(b) or got[-1] == b[j - 1]
            if left and right:
                return a[:i] + got + b[j:]
            if not left:
                i = max(0, 2 * i - len(a))
            if not right:
                j = min(len(b), 2 * j)

    def ids(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: of a token itself, else of the joined halves."""
        found = self.parts.get(word)
        if found is None:
            r = self.rank.get(word)
            half = len(word) // 2
            found = (r,) if r is not None else self.join(self.ids(word[:half]), self.ids(word[half:]))
            if len(word) <= PART:
                self.parts.keep(word, found, len(word) + 8 * len(found))
        return found

    def decoded(self, ids: list[int] | tuple[int, ...]) -> bytes:
        """The bytes of ids: those of both halves, concatenated."""
        if len(ids) <= 4096:
            return b"".join([self.spelled[i] for i in ids])
        half = len(ids) // 2
        return self.decoded(ids[:half]) + self.decoded(ids[half:])

    def piece(self, text: str) -> bytes:
        """Ids of a text, of which no part is cached."""
        find = pattern_for(text)
        words = find.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in find.finditer(text))
        raw = bytearray()
        while some := [*islice(words, 10_000)] if len(text) > LONG_TEXT else words:
            ids = [i for w in some for i in self.ids(w.encode("utf-8", "surrogatepass"))]
            raw += packed(ids)
            if some is words:
                break
        return bytes(raw)

    def chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk with the space before it; None if it is empty or has white space at an end, where a pre-token may
        not end."""
        if chunk.isascii() and chunk.isalpha():  # one pre-token
            found = packed(self.ids(b" " + chunk.encode()))
        else:
            found = None if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self.piece(" " + chunk)
        if len(chunk) <= LONG_CHUNK:
            self.chunks.keep(chunk, found, 4 * len(chunk) + len(found or b""))
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian uint32."""
        head, *rest = text.split(" ")
        if head and not head[-1].isspace() or not rest:
            parts = [*map(self.chunks.get, rest)]
            if None in parts:
                parts = [found or self.chunk(c) for found, c in zip(parts, rest, strict=True)]
            if None not in parts:
                return self.piece(head) + b"".join(parts)
        head, *rest = CUT.split(text)  # white space beyond single spaces: cut only where both neighbours are none
        return self.piece(head) + b"".join([self.chunks.get(c) or self.piece(" " + c) for c in rest])


def checked(model: TreeBpe) -> None:
    """Raise unless every token encodes to itself by a last merge of two tokens of lower rank."""
    for word, r in model.rank.items():
        if len(word) > 1 and not any(max(model.rank.get(word[:k], r), model.rank.get(word[k:], r)) < r for k in range(1, len(word))):
            raise ValueError(f"token {r} is no merge of two tokens before it")
        if model.merged(word) != (r,):
            raise ValueError(f"token {r} does not encode to itself")


@lru_cache(maxsize=2)
def tree_bpe(path: str) -> TreeBpe:
    """One encoder for each Python worker."""
    return TreeBpe(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of the whole text, little-endian uint32, one row per row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tree_bpe(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["_id"], "ids": [model.encode(t) for t in pdf["_text"]]})

    return with_long_ids(texts(docs), run, "ids binary")


def texts(docs: DataFrame) -> DataFrame:
    return in_small_batches(docs).select(F.col("doc_id").cast("string").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 of the whole text, encoded and decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tree_bpe(path)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["_id"], pdf["_text"], strict=True):
                raw = model.encode(text)
                back = model.decoded(np.frombuffer(raw, "<u4").tolist())
                rows.append((key, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return with_long_ids(texts(docs), run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
