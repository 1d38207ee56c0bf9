"""What the trained parts compute, against plain sets and loops."""

import math
import random
import string
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import language_id, secrets, url_filter
from vigilspark.llm.common import row_key


@pytest.mark.parametrize("n_langs", [3, 70])
def test_bit_sliced_filter_equals_plain_sets(n_langs):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = {f"l{k:02}": " ".join(rng.sample(words, 60)) for k in range(n_langs)}
    learned = {x: {int(h) for part in language_id.grams(t) for h in part} for x, t in texts.items()}
    table = pd.DataFrame([(x, np.uint64(h).astype(np.int64)) for x, hs in learned.items() for h in hs], columns=["lang", "gram"])
    model = language_id.Filter(sorted(learned), table, sorted(learned)[0])
    places = lambda h: [h >> 20 * k & (language_id.SLOTS - 1) for k in range(language_id.FUNCTIONS)]
    bits = {x: {p for h in hs for p in places(h)} for x, hs in learned.items()}
    for text in [*list(texts.values())[:3], " ".join(rng.sample(words, 30)), "zzz yyy", "a"]:
        asked = [int(h) for part in language_id.grams(text) for h in part]
        want = []
        for x in sorted(learned):
            hits = sum(all(p in bits[x] for p in places(h)) for h in asked)
            assert hits >= sum(h in learned[x] for h in asked)
            false = (len(bits[x]) / language_id.SLOTS) ** language_id.FUNCTIONS
            want.append(max(hits / len(asked) - false, 0) / (1 - false))
        assert np.allclose(model.shares(text), want)
        if any(want):
            best = max(range(n_langs), key=want.__getitem__)
            assert model.decide(text) == (sorted(learned)[best], pytest.approx(want[best] / sum(want)))


def test_samples_stay_bounded_whatever_repeats(spark):
    rows = spark.range(20_000).selectExpr("7L AS doc_id", "'same' AS text", "'en' AS lang", "id AS other")
    n = rows.withColumn("row", row_key()).where(F.pmod("row", F.lit(1 << 20)) < 0.1 * (1 << 20)).count()
    assert 1700 < n < 2300


def test_markov_scores_by_hand():
    chance, ordinary = ["a1b2c3d4", "zz99"], ["get_name", "name", "value_name"]
    table = secrets.ratios(secrets.transitions(chance), secrets.transitions(ordinary))
    model = secrets.Models(table, 0.0, 0.0, 0.0)
    code = lambda c: int(secrets.CODE[ord(c)])
    start = secrets.WIDTH - 1

    def log_p(tokens, a, b):
        pairs, singles, out = Counter(), Counter(), Counter()
        for t in tokens:
            for x, y in zip([start, *map(code, t)], map(code, t), strict=False):
                pairs[x, y] += 1
                singles[y] += 1
                out[x] += 1
        single = (singles[b] + 0.5) / (sum(singles.values()) + 0.5 * secrets.WIDTH)
        return math.log((pairs[a, b] + 8 * single) / (out[a] + 8))

    for token in ("a1b2", "name", "q_Z9"):
        steps = [*zip([start, *map(code, token)], map(code, token), strict=False)]
        assert model.score(token) == pytest.approx(sum(log_p(chance, a, b) - log_p(ordinary, a, b) for a, b in steps))


def test_url_fit_equals_a_plain_loop(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(5))
    urls = [(f"https://{word()}.{'net' if k % 3 else 'org'}/{'shop' if k % 2 else 'blog'}/{word()}", int(k % 2)) for k in range(60)]
    labelled = spark.createDataFrame([*urls, ("https://null.label/", None), (None, 1)], "url string, blocked int")
    steps = 6
    weights, intercept = url_filter.fit(labelled, steps)
    host, path = url_filter.split_url(F.col("url"))
    rows = [(float(r.blocked), sorted(r.s)) for r in labelled.where("blocked is not null").select("blocked", url_filter.slots(host, path).alias("s")).collect()]
    n, blocked = len(rows), sum(y for y, _ in rows)
    size = lambda s: max(len(s), 1) ** 0.5
    bound, now = defaultdict(float), {-1: math.log((blocked + 0.5) / (n - blocked + 0.5))}
    for _, s in rows:
        for j in s:
            bound[j] += (size(s) + 1) / 4 / size(s)
            now.setdefault(j, 0.0)
        bound[-1] += (size(s) + 1) / 4
    last = dict(now)
    for k in range(steps):
        ahead = {j: w + k / (k + 3) * (w - last[j]) for j, w in now.items()}
        gradient = defaultdict(float)
        for y, s in rows:
            e = y - 1 / (1 + math.exp(-(sum(ahead[j] for j in s) / size(s) + ahead[-1])))
            for j in s:
                gradient[j] += e / size(s)
            gradient[-1] += e
        last = now
        now = {j: w + (gradient[j] - (url_filter.DECAY * w if j >= 0 else 0)) / (bound[j] + (url_filter.DECAY if j >= 0 else 0)) for j, w in ahead.items()}
    assert intercept == pytest.approx(now[-1])
    assert all(weights[j] == pytest.approx(w, abs=1e-9) for j, w in now.items() if j >= 0) and sum(w != 0 for w in weights) == sum(j >= 0 and w != 0 for j, w in now.items())


def test_the_least_known_share_comes_from_all_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "with_known", lambda docs, model, *keep: docs.select(F.col("text").cast("double").alias("_known")))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), ((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) + 1) / float(1 << 30)).cast("string").alias("text"))
    got = language_id.least_known(docs, language_id.Filter(["en"], pd.DataFrame({"lang": [], "gram": []}), "en"))
    held = sorted(float(r.text) for r in docs.where(language_id.remainder() == 2).collect())
    assert got == min(held[-(-len(held) // 2) - 1] / 2, held[-(-len(held) // 100) - 1])
