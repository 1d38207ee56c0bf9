"""Hot entities and addresses in pieces: the same results as whole windows, and no large task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilspark.operators import features, ranking, segments, sequence

N = 900


@pytest.fixture(scope="module")
def log(spark):
    """Half of all events are one entity's, from one address, many at the same time; null addresses, outcomes and durations."""
    rng = np.random.default_rng(8)
    who = np.where(rng.random(N) < 0.5, 0, rng.integers(1, 40, N))
    pdf = pd.DataFrame({
        "event_id": [f"{k:05}" for k in rng.permutation(N)], "entity_id": [f"e{w}" for w in who], "entity_type": [("user", "edge_device")[int(x)] for x in rng.random(N) < 0.1],
        "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 300, N) * 1800, unit="s"), "source_ip": ["a" if w == 0 else f"b{w % 7}" if w % 5 else None for w in who],
        "geo_lat": rng.normal(size=N) * 40, "geo_lon": rng.normal(size=N) * 90, "resource_accessed": [f"/{x}" for x in rng.integers(0, 60, N) ** 2 // 70], "auth_success": rng.random(N) < 0.7,
        "session_duration_min": [None if x < 0.05 else x * 30 + 1e6 for x in rng.random(N)], "command_sequence": "[]", "device_os": [f"os{x}" for x in rng.integers(0, 3, N)], "device_mac": [f"m{x}" for x in rng.integers(0, 9, N)],
    })
    return spark.createDataFrame(pdf).withColumn("session_duration_min", F.when(~F.isnan("session_duration_min"), F.col("session_duration_min")))


def rows(df):
    return df.toPandas().sort_values("event_id").reset_index(drop=True)


@pytest.mark.parametrize("size", [50, 15])
def test_pieces_equal_whole_windows(log, monkeypatch, size):
    priors = features.population_priors(log)
    found = lambda: [rows(features.entity_windows(log, priors)), rows(features.ip_distinct_entities(log)), rows(sequence.entity_transitions(log))]
    whole = found()
    monkeypatch.setattr(segments, "ROWS", size)
    for a, b in zip(whole, found(), strict=True):
        pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-6, check_dtype=False)


@pytest.mark.parametrize("order", ["entity", "time"])
def test_features_are_the_same_however_they_are_dealt(log, monkeypatch, order):
    whole = rows(features.build_features(log, order))
    assert len(whole) == N and whole.seq_transition_score.notna().all()
    monkeypatch.setattr(sequence, "ROWS", 70)
    dealt = rows(features.build_features(log, order))
    monkeypatch.setattr(segments, "ROWS", 50)
    for got in (dealt, rows(features.build_features(log, order))):
        pd.testing.assert_frame_equal(whole, got[whole.columns], check_exact=False, rtol=1e-6, check_dtype=False)


def test_what_a_split_reads_is_derived_once(log, monkeypatch):
    """Both parts of a table with hot keys read it written, so the windows before are not run for each part."""
    monkeypatch.setattr(segments, "ROWS", 50)
    for part in segments.split(log.withColumn("n", F.rand()), "source_ip"):
        assert any("/split-" in f for f in part.inputFiles())


def test_features_join_no_events(log, monkeypatch):
    """Columns are carried through the population's counts: no table of all events is joined back by event_id."""
    monkeypatch.setattr(sequence, "ROWS", 70)
    plan = features.build_features(log)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "event_id" in line for line in plan.splitlines())


def test_a_hot_key_is_spread(log, monkeypatch):
    monkeypatch.setattr(segments, "ROWS", 50)
    for key in ("entity_id", "source_ip"):
        _, hot = segments.split(log, key)
        assert hot.select(key).distinct().count() < 5
        sizes = [r["count"] for r in segments.pieces(hot, key).groupBy(key, "_seg").count().collect()]
        assert max(sizes) <= 2 * segments.ROWS and sum(sizes) > N / 2.5 and len(sizes) >= 8
        halos = segments.with_halo(segments.pieces(hot, key), key, 20).groupBy(key, "_seg").agg(F.sum(F.col("_halo").cast("int")).alias("n")).collect()
        assert max(r.n for r in halos) == 20 and {r.n for r in halos} >= {0, 20}


def test_moments_far_from_zero(spark, monkeypatch):
    """Values of a million with a spread of one keep their spread over many pieces."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": "x", "timestamp": pd.Timestamp("2024-01-01"), "event_id": [f"{k:04}" for k in range(500)], "v": 1e9 + rng.normal(size=500)})
    monkeypatch.setattr(segments, "ROWS", 40)
    cut = segments.pieces(spark.createDataFrame(pdf), "k")
    own = cut.groupBy("_seg").agg(F.min("event_id").alias("first")).collect()
    for r in segments.moments(cut, "k", {"v": "v"}).collect():
        first = int(next(o["first"] for o in own if o["_seg"] == r["_seg"]))
        assert r["_rows"] == r["_n_v"] == first
        assert r["_m_v"] == pytest.approx(pdf.v[:first].mean(), abs=1e-4) and (r["_q_v"] / first) ** 0.5 == pytest.approx(pdf.v[:first].std(ddof=0), rel=1e-4)


@pytest.mark.parametrize("order", ["entity", "time"])
def test_population_counts_over_many_buckets(log, monkeypatch, order):
    """An entity's first event has no previous resource: it keeps its counts when the events are dealt."""
    pdf = sequence.entity_transitions(log).toPandas().sort_values(["entity_id", "timestamp", "event_id"] if order == "entity" else ["timestamp", "event_id"])
    monkeypatch.setattr(sequence, "ROWS", 70)
    got = sequence.population_counts(sequence.entity_transitions(log), order).toPandas().set_index("event_id").loc[pdf.event_id]
    nth = lambda *keys: pdf.groupby(list(keys), dropna=False).cumcount().to_numpy()
    new = nth("entity_type", "cur") == 0
    kinds = pd.Series(new.astype(int)).groupby(pdf.entity_type.to_numpy()).cumsum().to_numpy()
    first = pdf.prev.isna().to_numpy()
    assert first.sum() > 20 and len(got) == N
    for column, want, where in (("resource_count", nth("entity_type", "cur"), first), ("total", nth("entity_type"), first), ("different", kinds, first), ("pop_node", nth("entity_type", "prev"), ~first), ("pop_edge", nth("entity_type", "prev", "cur"), ~first)):
        assert got[column].to_numpy()[where].tolist() == want[where].tolist() and got[column][~where].isna().all()


def test_running_totals_keep_null_keys(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", 10)
    df = spark.createDataFrame([(None if k % 3 else "a", k, 1) for k in range(60)], "k string, v int, n int")
    got = ranking.running_totals(df, "v", "n", by=("k",)).collect()
    assert len(got) == 60 and all(r.before_n == (r.v // 3 if r.k else r.v - r.v // 3 - 1) for r in got)
