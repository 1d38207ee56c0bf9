"""Exact and near deduplication against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from vigilspark.llm import common, exact_dedup, near_dedup

EDGE = [(None, "null id"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "ONE"), (None, None), (6, "É"), (7, "é")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_groups(spark, docs_of):
    rng = random.Random(1)
    long = "".join(rng.choice("abcXYZé ") for _ in range(200))
    rows = EDGE + [(10, long), (11, long.swapcase().lower()), (12, long[:-1] + "!"), (13, long[1:]), (13, long[1:])] + [(20 + i, long[: 7 * i]) for i in range(12)]
    got = exact_dedup.exact_groups(docs_of(rows), block=16).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = max(ids, default=None)
        want.append((i, keep, len(groups[lower(t)]), i == keep))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=key) == sorted(want, key=key)


def test_exact_empty(spark, docs_of):
    assert exact_dedup.exact_groups(docs_of([(1, "x")]).limit(0)).count() == 0


def shingle_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]) and sets[b]:
                root[top(a)] = top(b)
    comp = defaultdict(list)
    for k in range(len(rows)):
        comp[top(k)].append(k)
    least = {k: min((rows[x][0] for x in v if rows[x][0] is not None), default=None) for v in comp.values() for k in v}
    return [(rows[k][0], len(sets[k]), least[k] if len(comp[top(k)]) > 1 or sets[k] else rows[k][0]) for k in range(len(rows))]


def near_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows, k = list(EDGE), 100
    for _ in range(90):  # copies with a few edits: many pairs lie close to the threshold
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = word()
        rows.append((k := k + 1, " ".join(w)))
    rows += [((k := k + 1), " ".join(word() for _ in range(rng.randrange(1, 60)))) for _ in range(40)]
    return rows + rows[-3:]


def test_near_groups(spark, docs_of, monkeypatch):
    rows = near_rows()
    for n, threshold, few in ((3, 0.85, 4), (5, 0.8, 12)):
        monkeypatch.setattr(near_dedup, "FEW", few)
        got = near_dedup.near_groups(docs_of(rows), n, threshold).collect()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(rows, n, round(100 * threshold)), key=key)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_in_small_blocks(spark, docs_of, monkeypatch):
    """Many open members of one bucket, blocks cut by number and by bytes, one text much longer than the others."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(100)]
    rows = [(1, " ".join(base * 40))]
    for k in range(70):
        w = list(base)
        for at in rng.sample(range(100), rng.choice([2, 4, 5, 6])):
            w[at] = word()
        rows.append((10 + k, " ".join(w)))
    for name, value in (("FEW", 2), ("BLOCK", 8), ("BLOCK_BYTES", 6000)):
        monkeypatch.setattr(near_dedup, name, value)
    got = near_dedup.near_groups(docs_of(rows), 3, 0.85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))


def test_hot_join(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id", "if(id < 3000, 7, id) AS k")
    table = rows.groupBy("k").agg({"*": "count"}).toDF("k", "n").selectExpr("k", "n", "k * 2 AS v")
    got = common.hot_join(rows, table, ["k"], "n")
    assert got.count() == 5000 and got.where("v != 2 * k").count() == 0 and got.columns == ["id", "k", "v"]


def test_scratch_deletes_all_but_what_is_kept(spark):
    with common.scratch(spark):
        gone, held = common.stash(spark.range(3), "gone"), common.stash(spark.range(4), "held", keep=True)
        assert gone.count() == 3
    assert held.count() == 4
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        gone.count()


def test_near_empty(spark, docs_of):
    assert near_dedup.near_groups(docs_of([(1, "x")]).limit(0)).count() == 0


def test_blocks_find_all_links(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 60).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (near_dedup.intersections(sets, sets) == np.array(want)).all()


def test_prune_bound_keeps_similar_pairs():
    least = near_dedup.least_matches(0.85, 1e-6)
    rng = np.random.default_rng(4)
    matches = np.cumsum(rng.random((2000, 256)) < 0.87, axis=1)[:, 31::32]
    assert (matches >= np.array(least)).all(axis=1).mean() > 0.999
