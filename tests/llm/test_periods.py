"""Periodic runs against the definition, tried for every period and place."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilspark.llm import periods


def brute(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words):
    return periods.word_runs(periods.numbers([str(w).encode() for w in words]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_few_words(words):
    assert found(words) == brute(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=6), st.integers(1, 60)), max_size=6))
def test_repeated_stretches(parts):
    words = [w for block, n in parts for w in (block * n)[:n]]
    assert found(words) == brute(words)


def test_long_runs_take_no_square_of_their_length():
    words = ["x"] * 100_000 + ["a", "b", "c"] * 30_000 + ["y"] + ["a"] * 50_000 + ["z"]
    assert found(words) == [(0, 100_000, 1), (100_000, 90_000, 3), (190_001, 50_000, 1)]


def test_many_words_before_one_phrase():
    rng = random.Random(4)
    words = [w for k in range(2000) for w in (f"left{k}", "one", "of", "the", "most", f"right{rng.randrange(50)}")] + ["one", "of"] * 4
    assert found(words) == [(12_000, 8, 2)]


def test_large_vocabularies(monkeypatch):
    ids = periods.numbers([str(k % 7).encode() for k in range(100)])
    ids[ids == 3] = 3_000_000  # three words do not fit 63 bits
    assert periods.word_runs(ids) == [(0, 100, 7)]


def looped(words, key):
    h, n, words = zlib.crc32(str(key).encode()), len(words), list(words)
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_documents(docs_of):
    rng = random.Random(5)
    rows = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \t\n"), (4, "É x\x1cy " * 9), (4, "É x\x1cy " * 9), (2**60 + 1, "b\tb\nb\x0bb\x0cb\rb")]
    rows += [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(200)))) for k in range(100, 200)] + [(500, "word " * 30_000)]
    docs = docs_of(rows)
    want = []
    for key, text in rows:
        words = looped(re.findall(r"[^\x20\x09-\x0D]+", text or ""), key)
        runs = brute(words) if key != 500 else [(0, 30_000, 1)]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((key, len(runs), *shown, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    order = lambda r: tuple((x is None, x) for x in r)
    got = periods.report(docs.withColumn("_id", docs.text).withColumn("start", docs.doc_id)).collect()
    assert sorted([tuple(r) for r in got], key=order) == sorted(want, key=order)
    assert sum(r.n_runs > 0 for r in got) > 9
    plain = {r.doc_id: r for r in periods.runs(docs.where("doc_id in (1, 4, 500)")).collect()}
    assert [tuple(r) for r in plain[500].runs] == [(0, 30_000, 1)] and plain[500].collapsed == "word" and plain[1].runs == [] and plain[4].collapsed == "É x\x1cy"
    assert periods.report(docs.limit(0)).count() == periods.runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3])
def test_shortest(words):
    assert found(words) == brute(words)
