"""SentencePiece encoding and decoding (operator 6): exact merge-type encoding by backtracking.

A text is cut where no piece of the vocabulary has the two characters side by side; no merge crosses such a place. Each
part is then encoded by Aho-Corasick matches: take the longest piece that starts here, keep it if it is compatible with
the piece before it, else try the next shorter one, else step back; a field of positions marks those from which
no encoding was found. Two adjacent pieces are compatible if merging their concatenation anew gives the two again;
answers are remembered. Words and parts met before come from caches bounded in bytes, in each Python worker; a full
cache drops its older half only, so frequent words stay.

Defined cases: null text is empty and has no ids; characters outside the vocabulary become byte pieces; a long text is
encoded whole, and its long words are not cached; repeated rows are encoded each; a null doc_id stays null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from operator import add

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Halves, in_small_batches, with_long_ids

MARK = "▁"
#: A space after another character starts a part.
CUT = re.compile(r"(?<=[^ ])(?= )")


class Pieces:
    def __init__(self, path: str, most: int = 320 << 20):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
        self.id = {m.id_to_piece(i): i for i in range(m.vocab_size()) if not special(i)}
        self.score = {p: m.get_score(i) for p, i in self.id.items()}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        if any(p[k] != MARK and p[k + 1] == MARK for p in self.id for k in range(len(p) - 1)):
            raise ValueError("a piece of this vocabulary spans words")
        self.piece = {i: p for p, i in self.id.items()}
        self.length, self.size, self.most = {i: len(p) for p, i in self.id.items()}, m.vocab_size(), max(map(len, self.id))
        #: The longest piece that a piece starts with, itself left out; -1 if there is none.
        self.shorter = {i: next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1) for p, i in self.id.items()}
        self.find = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.find.add_word(p, i)
        self.find.make_automaton()
        self.words, self.parts, self.fits = Halves(most // 4 * 3), Halves(most // 8), Halves(most // 8)

    def merged(self, text: str) -> list[str]:
        """Merge the best adjacent pair again and again, the leftmost of equals."""
        sym, nxt, prv = [*text], [*range(1, len(text) + 1)], [*range(-1, len(text) - 1)]
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(sym) and (s := self.score.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-s, a, b, sym[a] + sym[b]))

        for k in range(len(text) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, whole = heapq.heappop(heap)
            if not sym[a] or not sym[b] or sym[a] + sym[b] != whole or nxt[a] != b:
                continue
            sym[a], sym[b] = whole, ""
            nxt[a] = nxt[b]
            if nxt[b] < len(sym):
                prv[nxt[b]] = a
            offer(prv[a], a)
            offer(a, nxt[a])
        return [s for s in sym if s]

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b, of which two characters side by side are joined, stay apart when merged anew."""
        pair = a * self.size + b
        found = self.fits.get(pair)
        if found is None:
            found = self.fits.older.get(pair)
            if found is None:
                x, y = self.piece[a], self.piece[b]
                found = self.merged(x + y) == [x, y]
            self.fits.keep(pair, found, 0)  # two numbers
        return found

    def longest(self, text: str, at: int) -> int:
        """The longest piece that starts at a place; -1 if none does."""
        end, found = next(self.find.iter_long(text[at : at + self.most]), (-1, -1))
        return found if found >= 0 and end + 1 == self.length[found] else -1

    def backtrack(self, text: str) -> list[int]:
        """The only sequence of pieces of which every adjacent pair is compatible; any two neighbours in text are joined."""
        length, size, known, compatible = self.length, self.size, self.fits.get, self.compatible
        ids, last, at = [], -1, 0
        for end, piece in self.find.iter_long(text):  # the longest matches, as far as no step back is needed
            if end + 1 - length[piece] != at:
                break
            if last >= 0:
                fit = known(last * size + piece)
                if not (compatible(last, piece) if fit is None else fit):
                    break
            ids.append(piece)
            last, at = piece, end + 1
        if at == len(text):
            return ids
        failed, piece = bytearray(len(text) + 1), self.longest(text, at)
        while at < len(text):
            while piece >= 0 and (failed[at + length[piece]] or (ids and not compatible(ids[-1], piece))):
                piece = self.shorter[piece]
            if piece >= 0:
                ids.append(piece)
                at += length[piece]
                piece = self.longest(text, at)
                continue
            failed[at] = 1
            if not ids:
                raise ValueError(f"no encoding of {text!r}")
            piece = ids.pop()
            at -= length[piece]
            piece = self.shorter[piece]
        return ids

    def part(self, text: str) -> list[int]:
        """Ids of a part: of one unknown character its bytes, else by backtracking."""
        found = self.parts.get(text)
        if found is None:
            found = self.parts.older.get(text)
            if found is None and len(text) == 1 and text not in self.id:
                found = [self.byte[b] for b in text.encode("utf-8", "surrogatepass")]
            elif found is None:
                found = self.backtrack(text)
            self.parts.keep(text, found, 4 * len(text) + 8 * len(found))
        return found

    def word(self, key: str) -> str:
        """Decimal ids joined by commas of a word with the space before it; key leaves that out."""
        found = self.words.older.get(key) or self.spelled(key)
        self.words.keep(key, found, 4 * len(key) + len(found))
        return found

    def spelled(self, key: str) -> str:
        text = MARK + key
        joined = [*map(self.joined.__contains__, map(add, text, key))]
        if key and False not in joined:
            ids = self.backtrack(text)
        else:
            ids, start = [], 0
            for k, together in enumerate(joined, 1):
                if not together:
                    ids += self.part(text[start:k])
                    start = k
            ids += self.part(text[start:])
        return ",".join(map(str, ids))

    def encode(self, text: str) -> tuple[str, list[int]]:
        """Decimal ids joined by commas, and the ids; a space stands before the text, as in training."""
        if not text:
            return "", []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:].replace(" ", MARK) for w in CUT.split(" " + text)]
        else:
            words = text.split(" ")
        found = [*map(self.words.get, words)]
        if None in found:
            found = [f or self.word(w) for f, w in zip(found, words, strict=True)]
        decimal = ",".join(found)
        return decimal, [*map(int, decimal.split(","))]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=2)
def pieces_model(path: str) -> Pieces:
    """One encoder for each Python worker."""
    return Pieces(path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 of the whole text."""

    def run(batches):
        sp, digest = pieces_model(path), lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["_id"], pdf["_text"], strict=True):
                decimal, ids = sp.encode(text)
                rows.append((key, len(ids), digest(decimal), digest(sp.decode(ids))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = in_small_batches(docs).select(F.col("doc_id").cast("string").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    return with_long_ids(rows, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The ids themselves, one array per row."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces_model(path).encode(t or "")[1] for t in texts], dtype=object)

    return in_small_batches(docs).select("doc_id", ids("text").alias("ids"))
