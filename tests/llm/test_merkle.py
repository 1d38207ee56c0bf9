"""The manifest against a plain tree."""

import hashlib
import zlib

import pytest

from vigilspark.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(hashes):
    """(root, for each hash its (left, right) siblings from the bottom up)"""
    paths, at = [[] for _ in hashes], [*range(len(hashes))]
    while len(hashes) > 1:
        for k, i in enumerate(at):
            first = i // 8 * 8
            paths[k].append(("".join(hashes[first:i]), "".join(hashes[i + 1 : first + 8])))
        hashes, at = [sha("".join(hashes[i : i + 8])) for i in range(0, len(hashes), 8)], [i // 8 for i in at]
    return hashes[0], paths


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id, leaf(r, r.text))):
        by.setdefault(r.lang, []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([leaf(r, r.text) for r in by[x]]) for x in langs]
    root, above = tree([t[0] for t in trees])
    out = []
    for lang, (sub, paths), top in zip(langs, trees, above, strict=True):
        for r, path in zip(by[lang], paths, strict=True):
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(r, text)
            for a, b in path + top:
                fold = sha(a + fold + b)
            out.append((r.doc_id, leaf(r, r.text), sub, root, sha("".join(a + b for a, b in path + top)), fold, fold == root))
    return out


ORDER = lambda r: tuple((x is None, x) for x in r)
EDGE = [(None, "Null id", "en"), (None, None, None), (2, "", "en"), (3, None, "en"), (4, "Same", "de"), (4, "Same", "de"), (4, "Same", "de"), (5, "É\n", "é"), (6, "É" * 50_000, "en")]


@pytest.mark.parametrize("few", [merkle.FEW_NODES, 0])
def test_manifest(spark, docs_of, monkeypatch, few):
    monkeypatch.setattr(merkle, "ROWS", 50)
    monkeypatch.setattr(merkle, "FEW_NODES", few)
    docs = docs_of(EDGE + [(100 + 7 * k % 700, f"Text {k}", ("en", "en", "fr", None)[k % 4]) for k in range(300)] + [(k, "One", f"lang {k}") for k in range(900, 920)])
    got = [tuple(r) for r in merkle.audit(docs.withColumn("tree", docs.doc_id).withColumn("hash", docs.text)).collect()]
    assert sorted(got, key=ORDER) == sorted(brute(docs.collect()), key=ORDER)
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("rows", [[], [(1, "Alone", "en")], [(k, f"T{k}", "en") for k in range(9)], [(2, "A", "de"), (3, "B", None)]])
def test_small_tables(docs_of, rows):
    docs = docs_of(rows or [(1, "x")])
    docs = docs if rows else docs.limit(0)
    assert sorted([tuple(r) for r in merkle.audit(docs).collect()], key=ORDER) == sorted(brute(docs.collect()) if rows else [], key=ORDER)
