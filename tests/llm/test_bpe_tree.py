"""Tree-reduced byte-level BPE against tiktoken."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilspark.llm import bpe_tree
from vigilspark.llm.common import Cache
from vigilspark.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    return bpe_tree.TreeBpe(PATH)


@pytest.fixture(scope="module")
def library(model):
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.rank, special_tokens={})
    return lambda text: np.array(own.encode_ordinary(text), "<u4").tobytes()


def test_what_the_proof_rests_on(model):
    bpe_tree.checked(model)
    broken = bpe_tree.TreeBpe(PATH)
    broken.rank = {w: r for w, r in broken.rank.items() if w != b"re"} | {b"qqqqq": 60_000}
    broken.spelled += [b""] * 20_000
    with pytest.raises(ValueError):
        bpe_tree.checked(broken)


@settings(max_examples=300, deadline=None)
@given(a=st.text("abcdeor tn", max_size=40), b=st.text("abcdeor tn", max_size=40))
def test_join_is_a_homomorphism(a, b):
    model = bpe_tree.tree_bpe(PATH)
    a, b = a.encode(), b.encode()
    if a and b:
        assert model.join(model.merged(a), model.merged(b)) == model.merged(a + b) == model.merged_long([bytes([x]) for x in a + b])


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0aB1's.'re՘\U00011de0")), max_size=60))
def test_texts_equal_the_library(model, library, text):
    raw = model.encode(text)
    assert raw == library(text)
    assert model.decoded(np.frombuffer(raw, "<u4").tolist()) == text.encode()


def test_long_words_and_texts(model, library, monkeypatch):
    rng = random.Random(2)
    word = "".join(rng.choice("etaoinshr") for _ in range(20_000))
    texts = ["a" * 4099, "ab" * 3000 + "c", word, word + " " * 3000 + word[:99], "\n" * 999 + "x", "Ünï " * 2000, " a  b" * 500 + "\n"]
    for limit in (bpe_tree.LONG_TEXT, 500):
        monkeypatch.setattr(bpe_tree, "LONG_TEXT", limit)
        for text in texts:
            raw = model.encode(text)
            assert raw == library(text) and model.decoded(np.frombuffer(raw, "<u4").tolist()) == text.encode()
    assert all(len(c) <= bpe_tree.LONG_CHUNK for c in model.chunks)


def test_small_caches_change_nothing(library):
    model, rng = bpe_tree.TreeBpe(PATH), random.Random(3)
    model.chunks, model.parts, model.windows = Cache(300_000), Cache(300_000), Cache(300_000)
    for _ in range(300):
        text = " ".join("".join(rng.choice("aeiourst.,\n") for _ in range(rng.randint(0, 9))) for _ in range(40))
        assert model.encode(text) == library(text)
        assert max(model.chunks.held, model.parts.held, model.windows.held) <= 300_000


def test_documents(docs_of, library):
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "日本語 É"), (6, "x y " * 50_000)]
    docs = docs_of(rows)
    got = bpe_tree.round_trip(docs.withColumn("_id", docs.text).withColumn("_text", docs.doc_id), PATH).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    order = lambda r: tuple((x is None, x) for x in r)
    want = [(i, len(library(t or "")) // 4, sha(library(t or "")), sha((t or "").encode())) for i, t in rows]
    assert sorted([tuple(r) for r in got], key=order) == sorted(want, key=order)
    assert {(r.doc_id, bytes(r.ids)) for r in bpe_tree.encoded(docs, PATH).collect()} == {(i, library(t or "")) for i, t in rows}
    assert bpe_tree.round_trip(docs.limit(0), PATH).count() == 0
