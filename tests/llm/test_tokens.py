"""Tokens, packing and matrices against the libraries and against round trips."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from vigilspark.llm import matrices, packing, pieces
from vigilspark.llm.tokens import byte_bpe

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b \n c\n\n d\t e ", "it's   x \x1c y", " <|endoftext|> z", "日本 　語", "a\x85 b", "é ' s  's", "<s> <0x0A>", "▁a▁▁b", "a" * 50, "x "]


def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice("abcdeisntr ,.\n_-()=1▁é日") for _ in range(rng.randrange(90))) for _ in range(600)]


def test_byte_bpe_equals_library():
    t = Tokenizer.from_file(BPE)
    mark = "<|endoftext|>"
    given = texts() + [mark, mark * 2, f"a{mark}b", f"a  {mark}  b c", f"it{mark}'s\n{mark} x", mark[:-1]]
    got = byte_bpe(BPE).encode(given)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in given]


def test_pieces_equal_library():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.pieces_model(PIECE)
    for t in texts():
        decimal, ids = own.encode(t)
        assert ids == lib.encode(t) and decimal == ",".join(map(str, ids)) and own.decode(ids) == lib.decode(lib.encode(t))


def test_round_trip_query(spark, docs_of):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (3, "word"), (3, "word")]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(docs_of(rows), PIECE).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == Counter((k, len(i := lib.encode(t or "")), sha(",".join(map(str, i))), sha(lib.decode(i))) for k, t in rows)


def test_packing(spark, docs_of):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "of", "xyz"]) for _ in range(rng.randrange(120)))) for k in range(300)]
    rows += [(None, None), (500, ""), (501, "a b " * 300), (7, rows[7][1])]
    got = packing.pack(docs_of(rows), BPE, capacity=64, group=100).collect()
    ids = {}
    for k, raw in zip([k for k, _ in rows], byte_bpe(BPE).encode([t or "" for _, t in rows]), strict=True):
        ids[k] = raw + b"\0\0\0\0"
    seen = Counter((r.doc_id, r.piece) for r in got)
    assert all(n == (2 if k == 7 else 1) for (k, _), n in seen.items())
    for r in got:
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        assert r.length == 64 or len(ids[r.doc_id]) // 4 <= 64 or r.piece == 0
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.03 * total / 64 + 4


def step_of(bins, lengths, capacity, d):
    pool = packing.Underfull([[*b] for b in bins], lengths, capacity)
    for b in range(len(bins)):
        if b != d:
            pool.add(b)
    found = pool.step(d)
    return found and (found[0], [lengths[i] for i in found[1]], [lengths[i] for i in found[2]])


def test_steps_of_each_kind():
    assert step_of([[0, 1], [2]], [6, 3, 1], 10, 1) == (0, [1], [])  # a move
    assert step_of([[0, 1], [2]], [6, 3, 4], 10, 1) == (0, [4], [3])  # one for one
    assert step_of([[0, 1], [2, 3]], [6, 3, 2, 2], 10, 1) == (0, [2, 2], [3])  # two for one
    assert step_of([[0, 1, 2], [3, 4]], [2, 3, 4, 3, 3], 10, 1) in [(0, [3, 3], [5]), (0, [3], [2]), (0, [3, 3], [2, 3])]
    assert step_of([[0, 1], [2]], [6, 3, 3], 10, 1) is None  # equal sizes gain nothing
    assert step_of([[0], [1, 2]], [2, 6, 3], 10, 1) is None  # takers are at least as full


def test_squared_fill_rises_and_bins_empty(monkeypatch):
    rng, seen = random.Random(11), []

    class Watched(packing.Underfull):
        def step(self, d):
            assert sum(self.fill) == self.__dict__.setdefault("total", sum(self.fill))
            seen.append(sum(f * f for f in self.fill))
            return super().step(d)

    monkeypatch.setattr(packing, "Underfull", Watched)
    lengths = []
    for _ in range(60):  # triples that fill 100 exactly
        x = rng.randrange(25, 45)
        y = rng.randrange(25, 76 - x + 1) if x < 51 else 25
        lengths += [x, y, 100 - x - y]
    first = packing.best_fit(lengths, 100)
    bins = packing.local_search(first, lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(180)) and max(sum(lengths[i] for i in b) for b in bins) <= 100
    assert len(bins) < len(first) and len(bins) <= 63
    assert all(a <= b for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]


def test_local_search_ends_soon_on_documents_of_middle_length():
    rng = random.Random(12)
    lengths = [rng.randrange(600, 1001) for _ in range(2000)]
    began = time.time()
    first = packing.best_fit(lengths, 2048)
    assert len(packing.local_search(first, lengths, 2048)) < len(first) and time.time() - began < 30
    small = [rng.randrange(1, 9) for _ in range(3000)]  # hundreds of documents a bin
    assert len(packing.local_search(packing.best_fit(small, 2048), small, 2048)) == -(-sum(small) // 2048)


def test_very_long_text(spark, docs_of):
    got = packing.pack(docs_of([(1, "ab, " * 50_000), (2, "x")]), BPE).collect()
    n = len(byte_bpe(BPE).encode(["ab, " * 50_000])[0]) // 4 + 1
    own = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 1)
    assert sum(x for _, _, x in own) == n and [x for _, _, x in own[1:]] == [2048] * (len(own) - 1)


def test_best_fit_bins_hold_everything():
    rng = random.Random(7)
    lengths = [rng.randrange(1, 100) for _ in range(500)]
    for fit in (packing.best_fit, matrices.best_fit_decreasing, packing.pack_group):
        bins = fit(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(500)) and max(sum(lengths[i] for i in b) for b in bins) <= 100
    assert len(packing.best_fit(lengths, 100)) == len(matrices.best_fit_decreasing(lengths, 100))


def test_matrices_give_documents_back(spark, docs_of, tmp_path):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (99, "a b c " * 2000)]
    matrices.write_matrices(docs_of(rows), BPE, str(tmp_path / "m"), capacity=32, buffer=200)
    got = matrices.read_matrices(spark, str(tmp_path / "m")).collect()
    ids, positions = matrices.as_matrix(matrices.read_matrices(spark, str(tmp_path / "m")).toPandas(), 32)
    assert ids.shape == positions.shape == (len(got), 32) and matrices.packed_matrices(docs_of(rows).limit(0), BPE).count() == 0
    parts = {}
    for r in got:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 32 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts[doc, piece] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    for k, raw in zip([k for k, _ in rows], byte_bpe(BPE).encode([t or "" for _, t in rows]), strict=True):
        own = sorted((p, x) for (d, p), x in parts.items() if d == k)
        assert sum((x for _, x in own), []) == [*np.frombuffer(raw, "<u4").tolist(), 0]


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "x")]).limit(0)
    assert packing.pack(none, BPE).count() == matrices.packed_matrices(none, BPE).count() == pieces.round_trip(none, PIECE).count() == 0


def test_a_full_cache_keeps_frequent_words(monkeypatch):
    """op6: a word that every text has is encoded once, however often the cache is full; ids stay the library's."""
    own, met = pieces.Pieces(PIECE, 2 << 20), Counter()
    encode = own.backtrack
    monkeypatch.setattr(own, "backtrack", lambda text: met.update([text]) or encode(text))
    texts = [f"often {'x'.join(map(chr, range(97 + k % 20, 101 + k % 20)))}{k} q{k * 7919}" for k in range(20_000)]
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for t in texts:
        assert own.encode(t)[1] == lib.encode(t)
    assert met["▁often"] == 1 and len(own.words) < 20_000
