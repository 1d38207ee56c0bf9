"""Byte-level BPE ids of whole texts, with a cache of chunks per Python worker, bounded in bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import tiktoken

#: The pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space between two other characters always starts a pre-token, so texts are cut there.
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = re.compile(r"\s")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies spell bytes as printable characters: printable ones stand for themselves,
    the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def slices(texts: list[str], most: int = 500, characters: int = 1_000_000) -> Iterator[list[str]]:
    """texts in runs of at most so many and, but for a longer text, so many characters: words cost many times their text."""
    start = n = 0
    for k, t in enumerate(texts):
        if k > start and (k - start >= most or n + len(t) > characters):
            yield texts[start:k]
            start, n = k, 0
        n += len(t)
    if start < len(texts):
        yield texts[start:]


class ByteBpe:
    """Encodes texts chunk by chunk; chunks met before come from a dictionary bounded in bytes (most, and what one slice of
    texts adds), in which no chunk of over LONG characters stays."""

    LONG, OVERHEAD = 200, 200

    def __init__(self, path: str, most: int = 40 << 20):
        spec = json.load(open(path, encoding="utf-8"))
        chars, vocab = byte_of_char(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(chars[c] for c in w): i for w, i in vocab.items() if w not in special}
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if order != sorted(order):
            raise ValueError("the merges of this vocabulary do not follow its ids")
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.newline = ranks[b"\n"]
        self.special = {w: np.array([i], "<u4").tobytes() for w, i in special.items()}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.most, self.held, self.known = most, 0, {}

    def ids(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Encode new chunks, each with the space before it. Those without other white space go through one
        call: a line end before a space is always a pre-token of its own."""
        plain = [c for c in chunks if c and not SPACE.search(c)]
        if plain:
            ids = np.array(self.core.encode_ordinary("\n ".join(["", *plain, ""])), "<u4")
            at = np.flatnonzero(ids == self.newline)
            raw = ids.tobytes()
            self.known.update(zip(plain, [raw[4 * a + 4 : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], strict=True))
        for c in chunks.difference(plain):  # None: no pre-token may end here, so that the text needs the careful cut
            self.known[c] = None if not c or c[0].isspace() or c[-1].isspace() else self.ids(" " + c)

    def forget(self) -> None:
        """Empty the dictionary, at the end of a task: an idle worker holds the vocabulary alone."""
        self.known.clear()
        self.held = 0

    def careful(self, text: str) -> bytes:
        head, *rest = CUT.split(text)
        return self.ids(head) + b"".join([self.ids(" " + c) for c in rest])

    def apart(self, text: str) -> bytes:
        """A text with strings of special tokens: each is that token's id, and what lies between is encoded alone."""
        return b"".join([self.special[x] if x in self.special else self.careful(x) for x in self.mark.split(text)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every whole text as little-endian uint32 bytes, as the tokenizers library gives them by default: a string
        of a special token is that token."""
        out: list[bytes] = []
        for part in slices(texts):
            cut = [t.split(" ") for t in part]
            heads = [c.pop(0) for c in cut]
            chunks = set().union(*cut)
            new = chunks.difference(self.known)
            if self.held > self.most:
                self.forget()
                new = chunks
            self.learn(new)
            self.held += sum([self.OVERHEAD + 2 * len(c) + len(self.known[c] or b"") for c in new if len(c) <= self.LONG])
            find = self.known.__getitem__
            for text, head, rest in zip(part, heads, cut, strict=True):
                if any(w in text for w in self.special):
                    out.append(self.apart(text))
                    continue
                parts = [*map(find, rest)]
                odd = None in parts or rest and (not head or head[-1].isspace())
                out.append(self.careful(text) if odd else self.ids(head) + b"".join(parts))
            for c in new:
                if len(c) > self.LONG:
                    del self.known[c]
        return out


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer for each Python worker."""
    return ByteBpe(path)
