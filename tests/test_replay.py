"""Averages, peel-off and its replay against plain matrices, on random samples and on the given tables."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volley.operators import averages as A
from volley.operators import signal as D
from volley.plans import queries as Q
from volley.plans.fixtures import load

SF = "/root/testdata/sf0.001"


def matrix(df):
    p = df.toPandas().pivot(index="channel", columns="sample_idx", values="x")
    return p.to_numpy(), p.columns.to_numpy()


def sta(x, ts, half):
    inside = [t for t in ts if half <= t < x.shape[1] - half]
    return np.mean([x[:, t - half : t + half + 1] for t in inside], axis=0) if inside else None


def peel(x, ts, half):
    x, v = x.copy(), sta(x, ts, half)
    for t in ts if v is not None else []:
        for k in range(-half, half + 1):
            if 0 <= t + k < x.shape[1]:
                x[:, t + k] -= v[:, k + half]
    return x


def replayed(x, steps, half, lo, hi, filters=None, shown=None):
    """Residual and sources; steps: (unit or None, samples). With filters and shown spikes: the recalculating form."""
    sources = {}
    for u, ts in steps:
        if u is not None and (filters is not None or len(ts) > 1):
            w = x[:, ts].mean(1) if filters is None else filters[u]
            s = (w / np.abs(w).sum() if filters is None else w) @ x
            part = s[lo:hi]
            sources[u] = (s - part.mean()) / max(part.std(ddof=1), 1e-8)
            ts = ts if shown is None else shown[u]
        x = peel(x, ts, half)
    return x, sources


def check_sources(got, want):
    for u, s in want.items():
        assert np.allclose(got[got.unit_id == u].sort_values("sample_idx").s, s, atol=1e-5), u
    assert set(got.unit_id) == set(want)


@pytest.fixture
def recording(spark):
    g = np.random.default_rng(7)
    x = g.normal(size=(3, 400))
    rows = [(c, t, float(x[c, t])) for c in range(3) for t in range(400)]
    return x, spark.createDataFrame(rows, "channel int, sample_idx long, x double").repartition(4)


@pytest.mark.parametrize("half", [0, 1, 5, 40])
def test_averages_and_their_removal_in_blocks(spark, recording, monkeypatch, half):
    """Windows over the edges of blocks, spikes near both ends, a unit without a whole window, one spike twice."""
    monkeypatch.setattr(A, "AVERAGED", 16)
    monkeypatch.setattr(A, "PEELED", 32)
    x, df = recording
    trains = {4: [0, 3, 15, 16, 17, 31, 32, 63, 64, 200, 399], 9: [50, 50, 120], 11: [399], 12: [100]}
    spikes = spark.createDataFrame([(u, t) for u, ts in trains.items() for t in ts], "unit_id long, sample_idx long")
    got = A.spike_triggered_average(df, spikes, half).toPandas()
    for u, ts in trains.items():
        part, want = got[got.unit_id == u], sta(x, ts, half)
        if want is None:
            assert not len(part)
        else:
            assert np.allclose(part.pivot(index="channel", columns="off", values="v").to_numpy(), want)
    want = x.copy()
    for u, ts in trains.items():
        want += peel(x, ts, half) - x
    rest, at = matrix(A.peel_off(df, spikes, half))
    assert np.allclose(rest, want) and at.tolist() == list(range(400))


def test_missing_samples_and_other_columns(spark):
    rows = [("R", 0, t, None if t == 5 else float(t), "k") for t in range(20) if t not in (8, 9)] + [("R", 0, 3, 30.0, "k"), ("S", 0, 4, 1.0, "k")]
    df = spark.createDataFrame(rows, "recording_id string, channel int, sample_idx long, x double, unit_id string")
    spikes = spark.createDataFrame([("R", 1, 4), ("R", 1, 9), ("S", 1, 4)], "recording_id string, unit_id long, sample_idx long")
    got = {(r.recording_id, r.off): r.v for r in A.spike_triggered_average(df, spikes, 1).collect()}
    assert got == {("R", -1): (3 + 30) / 2, ("R", 0): 4.0, ("R", 1): 10.0}
    rest = A.peel_off(df, spikes, 1)
    assert rest.columns == df.columns and rest.count() == len(rows)
    assert {(r.sample_idx, r.x) for r in rest.filter("recording_id = 'R' and sample_idx in (3, 4, 5, 10)").collect()} == {(3, 3 - 16.5), (3, 30 - 16.5), (4, 0.0), (5, None), (10, 0.0)}
    for empty in (df.limit(0), df):
        assert A.spike_triggered_average(empty, spikes.limit(0), 1).collect() == [] and A.peel_off(empty, spikes.limit(0), 1).count() == empty.count()


@pytest.mark.parametrize("compact", [1, 2, 100])
def test_replay_on_deltas(spark, recording, compact):
    """Whenever the residual is written; a step otherwise writes its spikes and waveforms only."""
    x, df = recording
    plan = [(2, [20, 60, 61, 300]), (None, [33, 90]), (5, [25, 80, 200]), (2, [100, 101]), (7, [10])]
    steps = spark.createDataFrame([(k, u, t) for k, (u, ts) in enumerate(plan) for t in ts], "step int, unit_id long, sample_idx long")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    rest, sources, used, shown = D.replay_peel_off(df, steps, None, 3, 50, 350, compact=compact)
    residuals = [p for p in set(os.listdir(root)) - before if p.startswith("residual")]
    assert len(residuals) == len(plan) // compact
    y = x
    for k, (u, ts) in enumerate(plan):
        y, want = replayed(y, [(u, ts)], 3, 50, 350)
        for v, s in want.items():
            got = sources.filter(F.col("unit_id") == v).toPandas().sort_values("sample_idx", kind="stable")
            assert any(np.allclose(part, s) for part in ([got.s] if len(got) == 400 else [got.s[::2], got.s[1::2]]))
    assert np.allclose(matrix(rest)[0], y)
    assert shown.count() == sum(len(ts) for u, ts in plan if u is not None) and used.count() == 9


def test_recalculating_and_detected_spikes(spark, recording):
    x, df = recording
    plan = [(2, [20, 60, 300]), (None, [33, 90]), (5, [25, 80]), (8, [140, 160])]
    g = np.random.default_rng(1)
    filters = {2: g.normal(size=3), 5: g.normal(size=3)}
    rows = spark.createDataFrame([(u, c, float(w[c])) for u, w in filters.items() for c in range(3)], "unit_id long, channel int, w double")
    steps = spark.createDataFrame([(k, u, t) for k, (u, ts) in enumerate(plan) for t in ts], "step int, unit_id long, sample_idx long")
    rest, sources, _, shown = D.replay_peel_off(df, steps, rows, 3, 50, 350, distance=5, recalculate=True)
    found = {u: sorted(p.sample_idx) for u, p in shown.toPandas().groupby("unit_id")}
    y, want = x, {}
    for u, ts in plan:
        y, s = replayed(y, [(u, ts)], 3, 0, 400, filters if u in filters else None, found if u in filters else None)
        want |= s if u in filters else {}
    check_sources(sources.toPandas(), want)
    assert np.allclose(matrix(rest)[0], y) and found[8] == [140, 160]
    again = D.source_to_timestamps(sources.withColumn("port", F.lit("")), 5).toPandas()
    assert all(sorted(again[again.unit_id == u].sample_idx) == found[u] for u in filters)
    # saved spikes are peeled off, those of the sources are shown
    rest, _, _, shown = D.replay_peel_off(df, steps, None, 3, 50, 350, distance=5)
    assert np.allclose(matrix(rest)[0], replayed(x, plan, 3, 50, 350)[0])
    assert shown.filter("unit_id = 2").count() > 3
    with pytest.raises(ValueError):
        D.replay_peel_off(df, steps, None, 3, 50, 350, recalculate=True)


def given(spark):
    x, at = matrix(Q.emb(spark, SF))
    assert at.tolist() == list(range(x.shape[1]))
    labels = load(spark, SF, "spikes_lab").toPandas()
    return x, [(None if u % 3 == 2 else u, sorted(p.sample_idx)) for u, p in labels.groupby("unit_id")]


def test_the_query_replays_all_labels(spark):
    x, steps = given(spark)
    assert len(steps) == 10
    got, _ = matrix(Q.QUERIES["replay_peel_off"](spark, SF))
    assert np.allclose(got, replayed(x, steps, Q.HALF, 0, 400)[0], atol=2e-6)


def test_the_query_of_full_sources(spark):
    """Noise in the rejected channels, whitening, then the replay: all in plain matrices from the noise on."""
    x, steps = given(spark)
    bad = Q.emb(spark, SF).select("channel").distinct().filter("channel % 9 = 0")
    noisy, _ = matrix(D.replace_bad_channels(Q.emb(spark, SF), bad))
    rows = [c for c in range(64) if c % 9]
    assert np.array_equal(noisy[rows], x[rows]) and not np.array_equal(noisy[0], x[0])
    vals, vecs = np.linalg.eigh(np.cov(noisy))
    white = (vecs / np.sqrt(np.maximum(vals, 0) + 1e-8)) @ vecs.T @ noisy
    got = Q.QUERIES["compute_full_sources"](spark, SF).toPandas()
    want = replayed(white, steps, Q.HALF, 0, 400)[1]
    assert len(want) == 7 and isinstance(got, pd.DataFrame)
    check_sources(got, want)
