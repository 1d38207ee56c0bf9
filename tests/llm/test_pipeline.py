"""The pipeline's stages against brute force, with null and repeated ids."""

import os
import random
from collections import defaultdict

import corpus_pipeline
from test_dedup import EDGE, lower, shingle_set

from vigilspark.llm import packing
from vigilspark.llm.queries import tokenizer
from vigilspark.llm.tokens import byte_bpe


def rows_of():
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    a, b, c, d, e = (text(60) for _ in range(5))
    rows = [*EDGE, (None, a), (50, a + " more"), (None, text(40)), (None, text(40))]  # a null id in a group with an id; clean null ids
    rows += [(60, b), (61, b + " more"), (61, text(50)), (60, text(50))]  # an id of a near copy also has a clean text
    rows += [(None, c + " zz"), (None, c + " yy"), (70, d + " zz"), (70, d + " yy"), (70, d + " yy"), (71, d)]  # only null ids; a shared smallest id
    return [*rows, (80, e), (80, e.upper()), (None, text(9) + "A"), (None, rows[-1][1]), (90, None), (90, "")]


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append((i, t))
    best = lambda g: min(g, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or ""))
    return [best(g) for g in groups.values()]


def near_brute(rows):
    sets, root = [shingle_set(t, 5) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[root[k]].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) for g in groups.values()]


def pairs(df):
    return ordered((r.doc_id, r.text) for r in df.collect())


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_dedup_stages_keep_one_row_of_each_group(spark, docs_of):
    rows = rows_of()
    assert pairs(corpus_pipeline.exact(spark, docs_of(rows), "")) == ordered(exact_brute(rows))
    assert pairs(corpus_pipeline.near(spark, docs_of(rows), "")) == ordered(near_brute(rows))


CLASH = ("_known", "_id", "_sha", "_none", "row", "id", "sha", "again_id", "gone_sha", "tied_id", "first", "root", "part", "_key", "_judged", "a.b")


def test_stages_keep_columns_that_clash_and_empty_tables(spark, docs_of):
    docs = docs_of([(i, t, "en") for i, t in rows_of()] + [(700, "mail password = hunter2hunter2 now", "en")])
    docs = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASH])
    columns = [f"`{c}`" for c in docs.columns]
    for stage in (corpus_pipeline.language, corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.secret):
        out = stage(spark, docs, "").select(*columns)
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in CLASH)
        assert stage(spark, docs.limit(0), "").select(*columns).collect() == []


def test_secret_changes_only_what_it_must(spark, docs_of):
    rows = [(1, "plain text"), (2, None), (3, ""), (4, "mail password = hunter2hunter2 now"), (None, "x " * 50_000)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secret(spark, docs_of(rows), "").collect()}
    clean = got.pop(4)
    assert got == {i: (t, 1) for i, t in rows if i != 4}  # n_chars is 1 in the fixture, and stays
    assert "hunter2" not in clean[0] and clean[1] == len(clean[0])


def test_run_keeps_what_the_stages_keep(spark, docs_of, tmp_path):
    docs_of([(i, t, "en") for i, t in rows_of()]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = near_brute(exact_brute([(r.doc_id, r.text) for r in corpus_pipeline.language(spark, docs, "").collect()]))
    want = packing.pack(docs_of(left), tokenizer("byte_bpe_50k.json"))
    packed = lambda df: ordered((r.doc_id, r.length, r.ids_crc32) for r in df.collect())
    assert packed(corpus_pipeline.run(spark, str(tmp_path))) == packed(want)
    found = {x.rsplit("-", 1)[0] for x in os.listdir(spark.conf.get("spark.checkpoint.dir"))}
    assert "secret-scans" in found and not found & {"language-ID", "exact-dedup", "MinHash-near-dedup"}
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    rows.write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_a_secret_is_gone_from_what_is_packed(spark, docs_of, tmp_path):
    text = "some words before the token: abcdef0123456789abcdef and some after"
    docs_of([(1, text, "en"), (2, "other words that are here to be learned and packed", "en")]).write.parquet(str(tmp_path / "documents.parquet"))
    left = corpus_pipeline.secret(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").where("doc_id = 1").first()
    assert "abcdef0123456789" not in left.text and left.n_chars == len(left.text)
    packed = {r.doc_id: r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed[1] == len(byte_bpe(tokenizer("byte_bpe_50k.json")).ids(left.text)) // 4 + 1


def test_language_rejects_texts_in_no_learned_language(spark, docs_of):
    rng = random.Random(8)
    words = {"en": "the and of that with have this from they would there their what about which".split(), "de": "der die und nicht mit sich auch nach einem über wird werden durch noch können".split()}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for k, lang in enumerate(["en", "de"] * 60)]
    clean = rows + [(500, "The they there", None), (None, "werden und nicht", None)]
    odd = [(600, "Быстрая лиса прыгает", None), (601, "qzx vjk wqp xxz kqj zzq", None), (602, "12 + 7", "en"), (603, None, "de"), (None, "ждёт", None)]
    assert pairs(corpus_pipeline.language(spark, docs_of(clean + odd), "")) == ordered((i, t) for i, t, _ in clean)
    for lang in ([(i, t, None) for i, t, _ in clean + odd], [(1, "a b", None), (2, None, "en"), (3, "7", "en")]):  # nothing to learn
        want = ordered((i, t) for i, t, _ in lang if any(x.isalpha() for x in t or ""))
        assert pairs(corpus_pipeline.language(spark, docs_of(lang), "")) == want


def test_only_rows_that_may_be_gone_are_compared(spark):
    """Every gone row is marked, null ids and ids with several texts too; almost no other row is; the result is that of the plain join."""
    rows = spark.range(0, 40_000, 1, 7).selectExpr("if(id % 100 = 0, null, id div 2) AS id", "if(id % 997 = 1, null, sha2(cast(id AS string), 256)) AS sha", "struct(id) AS row")
    gone = corpus_pipeline.stash(rows.where("sha is not null and crc32(sha) % 50 = 0").select("id", "sha"), "gone")
    marked, keys = corpus_pipeline.maybe_in(rows, gone), {tuple(r) for r in gone.collect()}
    assert len(keys) > 500 and any(i is None for i, _ in keys)
    maybe = [(r.id, r.sha) for r in marked.where("_maybe").collect()]
    assert marked.count() == 40_000 and keys <= set(maybe) and len(maybe) < len(keys) + 40_000 * 2 / corpus_pipeline.BITS_EACH
    left = [(r.id, r.sha, r.row.id) for r in corpus_pipeline.without(rows, gone).collect()]
    assert sorted(left, key=lambda r: r[2]) == [(r.id, r.sha, r.row.id) for r in sorted(rows.collect(), key=lambda r: r.row.id) if (r.id, r.sha) not in keys]
    assert corpus_pipeline.without(rows, gone.where("false")).count() == 40_000
