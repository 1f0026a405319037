"""Hand-worked cases of the rules, invariants over random trains, and several recordings in one table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volley.operators import duplicates as G
from volley.operators import properties as P
from volley.operators import signal as D
from volley.operators import trains as E

FS = 1000.0


def frame(spark, units):
    return spark.createDataFrame([("P0", int(u), int(t), float(h)) for u, (ts, hs) in units.items() for t, h in zip(ts, hs)], "port string, unit_id long, sample_idx long, height double")


def made(seed, sources):
    g = np.random.default_rng(seed)
    out = {}
    for u in range(40):
        n = int(g.integers(1, 40))
        src = sources[u]
        ts = np.sort(g.choice(len(src), n, replace=False))
        out[u] = (ts, src[ts])
    return out


@pytest.fixture(scope="module")
def data(spark):
    g = np.random.default_rng(7)
    src = {u: np.round(np.exp(g.normal(0, 1.2, 1500)), 4) for u in range(40)}
    units = made(3, src)
    return src, units, frame(spark, units), spark.createDataFrame([("P0", u, i, float(x)) for u, s in src.items() for i, x in enumerate(s)], "port string, unit_id long, sample_idx long, s double")


def got(df):
    out = {}
    for r in df.select("unit_id", "sample_idx").collect():
        out.setdefault(r.unit_id, []).append(r.sample_idx)
    return {u: sorted(v) for u, v in out.items()}


def every(heights, step=100):
    return [k * step for k in range(len(heights))], heights


def test_low_heights_by_hand(spark):
    units = {
        1: every([10, 10, 1, 10, 10]),  # one low spike goes
        2: every([20, 20, 20, 1, 4, 9, 9, 20, 20]),  # 1 is low, 4 only below the share of the mean: it goes with the one before
        3: every([20, 20, 20, 1, 1, 4.9, 20, 20, 20]),  # two low ones go, the next is not dropped with them
        4: every([5]),  # its own neighbour
        5: every([10, 1, 10]),
    }
    assert got(E.rule1_low_height(frame(spark, units))) == {1: [0, 100, 300, 400], 2: [0, 100, 200, 500, 600, 700, 800], 3: [0, 100, 200, 500, 600, 700, 800], 4: [0], 5: [0, 200]}


def test_high_rates_by_hand(spark):
    units = {
        1: ([0, 100, 110, 300], [5, 5, 3, 5]),  # 100 Hz: the lower one goes
        2: ([0, 100, 110, 300], [5, 5, 5, 5]),  # the first of equals
        3: ([0, 10, 20, 30], [4, 3, 2, 1]),  # the second goes, so its pair with the third is passed over, and so on
        4: ([0, 10, 20, 30], [1, 2, 3, 4]),  # each first one goes
        5: ([0], [1]),
        6: ([0, 100, 200, 300], [1, 1, 1, 1]),  # nothing is fast
    }
    assert got(E.rule2_high_rate(frame(spark, units), FS)) == {1: [0, 100, 300], 2: [0, 110, 300], 3: [0, 20], 4: [30], 5: [0], 6: [0, 100, 200, 300]}


def test_rate_outliers_by_hand(spark):
    units = {
        1: ([0, 100, 200, 300, 310, 400, 500], [5, 5, 5, 5, 4, 5, 5]),  # 100 Hz among 10 Hz
        2: ([0, 100, 110], [5, 5, 4]),  # too few rates
    }
    assert got(E.remove_ifr_outliers(frame(spark, units), FS)) == {1: [0, 100, 200, 300, 400, 500], 2: [0, 100, 110]}


def sources(spark, values, n=700):
    return spark.createDataFrame([("P0", u, t, float(at.get(t, 0.0))) for u, at in values.items() for t in range(n)], "port string, unit_id long, sample_idx long, s double")


def test_added_peaks_by_hand(spark):
    times = [0, 100, 200, 400]  # 10, 10, 5 Hz: windows of 59 samples
    spikes = frame(spark, {u: (times, [10.0] * 4) for u in (1, 2, 3)})
    at = {t: 10.0 for t in times}
    high = sources(spark, {1: at | {300: 9.0, 301: 9.0}, 2: at | {300: 4.0}, 3: at | {405: 9.0}})
    assert got(E.rule3_add_peaks(spikes, high, FS)) == {1: [0, 100, 200, 300, 400], 2: times, 3: times}


def test_filled_gaps_by_hand(spark):
    times = [0, 100, 200, 300, 500, 600]
    spikes = frame(spark, {u: (times, [10.0] * 6) for u in (1, 2, 3)})
    at = {t: 10.0 for t in times}
    # 390 parts the gap of 300 to 500 into 11.1 and 9.1 Hz; 310 would make 100 Hz; 2 is too low at any place
    inside = sources(spark, {1: at | {390: 6.0, 391: 6.0}, 2: at | {310: 6.0}, 3: at | {390: 2.0}})
    assert got(E.rule4_fill_gaps(spikes, inside, FS)) == {1: [0, 100, 200, 300, 390, 500, 600], 2: times, 3: times}


def test_rules_keep_their_promises(spark, data):
    src, units, spikes, sources_ = data
    before = got(spikes)
    for kept in (got(E.rule1_low_height(spikes)), got(E.rule2_high_rate(spikes, FS)), got(E.remove_ifr_outliers(spikes, FS))):
        assert all(set(v) <= set(before[u]) and len(v) == len(set(v)) for u, v in kept.items())
    for rule in (E.rule3_add_peaks, E.rule4_fill_gaps):
        more = got(rule(spikes, sources_, FS))
        assert {u: len(v) for u, v in more.items()} != {u: len(v) for u, v in before.items()}
        for u, v in more.items():
            new = set(v) - set(before[u])
            assert set(before[u]) <= set(v) and len(v) == len(set(v)) and all(before[u][0] < t < before[u][-1] for t in new)
        again = {r.sample_idx: r.height for r in rule(spikes, sources_, FS).filter("unit_id = 5").collect()}
        assert all(h == pytest.approx(src[5][t]) for t, h in again.items())
    assert got(E.rule2_high_rate(spikes.repartition(7), FS)) == got(E.rule2_high_rate(spikes.coalesce(1), FS))


def test_auto_edit_is_the_rules_in_turn(spark, data):
    _, units, spikes, sources_ = data
    able = spikes.join(spikes.groupBy("unit_id").count().filter("count >= 4").select("unit_id"), "unit_id", "left_semi").select(*spikes.columns)
    both = lambda df: E.rule2_high_rate(E.rule1_low_height(df), FS)
    step = spark.createDataFrame(both(able).collect(), spikes.schema)
    step = spark.createDataFrame(E.rule4_fill_gaps(E.rule3_add_peaks(step, sources_, FS), sources_, FS).collect(), spikes.schema)
    sizes = {r.unit_id: r["count"] for r in step.groupBy("unit_id").count().collect()}
    last = got(both(step))
    want = {u: last[u] if n >= 4 else got(step)[u] for u, n in sizes.items()}
    want |= {u: [int(t) for t in ts] for u, (ts, _) in units.items() if len(ts) < 4}
    assert got(E.auto_edit(spikes, sources_, FS)) == {u: v for u, v in want.items() if v}


def test_neighbours(spark):
    spikes = frame(spark, {1: ([10, 20, 9000], [1.0, 2.0, 3.0])})
    near = {r.sample_idx: r for r in E.with_neighbours(sources(spark, {1: {}}, 9500), spikes).collect()}
    assert sorted(near) == list(range(10, 9000))
    assert near[10]._is_spike and near[10]._p2 is None and near[10]._n1.sample_idx == 20 and near[10]._n2.sample_idx == 9000
    assert not near[8999]._is_spike and near[8999]._p1.sample_idx == 20 and near[8999]._p2.sample_idx == 10 and near[8999]._n2 is None


def test_clicks_fall_back_to_the_highest_sample(spark):
    spikes = frame(spark, {1: ([10], [1.0])})
    clicks = spark.createDataFrame([("P0", 1, 50), ("P0", 1, 200)], "port string, unit_id long, at long")
    peaks = spark.createDataFrame([("P0", 1, 53)], "port string, unit_id long, sample_idx long")
    assert got(E.add_at(spikes, peaks, clicks, 5, sources(spark, {1: {203: 2.0, 204: 2.0}}))) == {1: [10, 53, 203]}
    assert got(E.add_at(spikes, peaks, clicks, 5)) == {1: [10, 53]}


def test_force_at_recruitment_is_the_last_sample_before(spark):
    spikes = frame(spark, {1: ([5000, 5100], [1, 1]), 2: ([3, 90], [1, 1]), 3: ([12000, 12100], [1, 1])})
    force = spark.createDataFrame([(10, 1.0), (40, 2.0), (4990, 3.0), (5001, 4.0)], "sample_idx long, x double")
    assert {r.unit_id: r.force for r in E.recruitment_gain(spikes, force, FS).collect()} == {1: 3.0, 2: 1.0, 3: 4.0}


def test_recordings_are_kept_apart(spark, data):
    """Two recordings with the same ports, units and samples: each gives what it gives alone."""
    src, units, spikes, sources_ = data
    other = spikes.withColumns({"sample_idx": F.col("sample_idx") + 3, "height": 6 - F.col("height")})
    both = spikes.withColumn("recording_id", F.lit("a")).unionByName(other.withColumn("recording_id", F.lit("b")))
    src2 = sources_.withColumn("recording_id", F.lit("a")).unionByName(sources_.withColumns({"recording_id": F.lit("b"), "sample_idx": F.col("sample_idx") + 3}))
    pairs = [
        lambda x, s: E.firing_stats(x, FS), lambda x, s: E.rule1_low_height(x), lambda x, s: E.rule2_high_rate(x, FS), lambda x, s: E.remove_ifr_outliers(x, FS), lambda x, s: E.rule3_add_peaks(x, s, FS), lambda x, s: E.rule4_fill_gaps(x, s, FS),
        lambda x, s: E.inst_discharge_rate(E.rebin_spikes(x, FS, 10.0), 10), lambda x, s: E.cumulative_spike_train(E.inst_discharge_rate(E.rebin_spikes(x, FS, 10.0), 10)), lambda x, s: G.rate_of_agreement(x, 2),
        lambda x, s: E.order_units(x, x.select(*E.unit_of(x)).distinct(), FS), lambda x, s: D.local_maxima(s), lambda x, s: D.pnr_db(s, x),
    ]
    few = F.col("unit_id") < 8
    for f in pairs:
        whole = f(both.filter(few), src2.filter(few))
        for name, x, s in (("a", spikes, sources_), ("b", other, src2.filter("recording_id = 'b'").drop("recording_id"))):
            alone = f(x.filter(few), s.filter(few))
            rows = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.select(*alone.columns).collect())
            assert rows(whole.filter(F.col("recording_id") == name)) == rows(alone)


def test_signals_of_recordings_are_kept_apart(spark):
    g = np.random.default_rng(1)
    x = spark.createDataFrame([(c, t, float(v)) for c in range(4) for t, v in enumerate(g.normal(size=60))], "channel int, sample_idx long, x double")
    y = x.withColumns({"x": F.col("x") * 3 + F.col("channel"), "sample_idx": F.col("sample_idx") + 5})
    both = x.withColumn("recording_id", F.lit("a")).unionByName(y.withColumn("recording_id", F.lit("b")))
    spikes = spark.createDataFrame([(u, t) for u in (1, 2) for t in range(10 + u, 50, 5 + 3 * u)], "unit_id long, sample_idx long")
    two = spikes.withColumn("recording_id", F.lit("a")).unionByName(spikes.withColumn("recording_id", F.lit("b")))
    w = spark.createDataFrame([(u, c, float(u * c - 1)) for u in (1, 2) for c in range(4)], "unit_id long, channel int, w double")
    steps = spikes.withColumn("step", F.col("unit_id"))
    pairs = [
        lambda s, k, p: D.time_differentiate(s, 16), lambda s, k, p: D.extend(s, 2, 4), lambda s, k, p: D.channel_covariance(s), lambda s, k, p: D.apply_matrix(s, D.whitening_matrix(D.channel_covariance(s))), lambda s, k, p: D.apply_unit_filter(s, w, 10, 40),
        lambda s, k, p: D.rms_envelope(s, 4), lambda s, k, p: D.pooled_std(s), lambda s, k, p: D.peel_off(s, k, 2), lambda s, k, p: D.muap_features(D.center_muap(D.spike_triggered_average(s, k, 2))), lambda s, k, p: D.replay_peel_off(s, p, None, 2, 10, 40)[0], lambda s, k, p: D.replay_peel_off(s, p, None, 2, 10, 40)[1],
        lambda s, k, p: D.decimate(s, 20), lambda s, k, p: D.force_report(s), lambda s, k, p: D.force_peak(D.normalise_force(s)),
    ]
    for f in pairs:
        whole = f(both, two, two.withColumn("step", F.col("unit_id")))
        for name, s in (("a", x), ("b", y)):
            alone = f(s, spikes, steps)
            rows = lambda df: sorted(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select(*alone.columns).collect())
            a, b = rows(whole.filter(F.col("recording_id") == name)), rows(alone)
            assert len(a) == len(b) and np.allclose(np.array(a, float), np.array(b, float), atol=2e-6, equal_nan=True)


def test_replay(spark):
    """Steps by plain arrays: a rejected repeat is only peeled off; stop_before leaves the residual of the steps before."""
    g = np.random.default_rng(5)
    m = g.normal(size=(3, 80))
    x = spark.createDataFrame([(c, t, float(m[c, t])) for c in range(3) for t in range(80)], "channel int, sample_idx long, x double")
    plan = [(7, [10, 30, 52]), (None, [20, 44]), (9, [15, 60])]
    steps = spark.createDataFrame([(k, u, t) for k, (u, ts) in enumerate(plan) for t in ts], "step int, unit_id long, sample_idx long")

    def peeled(r, ts):
        sta = np.mean([r[:, t - 2 : t + 3] for t in ts], axis=0)
        r = r.copy()
        for t in ts:
            r[:, t - 2 : t + 3] -= sta
        return r

    def matrix(df):
        return df.toPandas().pivot(index="channel", columns="sample_idx", values="x").to_numpy()

    want, sources_ = m, {}
    for u, ts in plan:
        if u is not None:
            w = want[:, ts].mean(1)
            s = (w / np.abs(w).sum()) @ want
            sources_[u] = (s - s[10:70].mean()) / s[10:70].std(ddof=1)
        before, want = want, peeled(want, ts)
    rest, src, used, _ = D.replay_peel_off(x, steps, None, 2, 10, 70)
    assert np.allclose(matrix(rest), want)
    for u, s in sources_.items():
        assert np.allclose(src.filter(F.col("unit_id") == u).orderBy("sample_idx").toPandas().s, s)
    assert used.count() == 6
    stopped = D.replay_peel_off(x, steps, None, 2, 10, 70, stop_before=spark.createDataFrame([(9,)], "unit_id long"))[0]
    assert np.allclose(matrix(stopped), before)
    edited = spark.createDataFrame([(9, 15), (9, 61)], "unit_id long, sample_idx long")
    w = before[:, [15, 61]].mean(1)
    s = (w / np.abs(w).sum()) @ before
    again = D.recalculate_filter(x, edited, 10, 70, steps, 2).orderBy("sample_idx").toPandas().s
    assert np.allclose(again, (s - s[10:70].mean()) / s[10:70].std(ddof=1))


def test_long_channels_in_blocks(spark):
    g = np.random.default_rng(2)
    x = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(g.normal(size=6000).cumsum())], "channel int, sample_idx long, x double")
    one = D.bandpass_notch(x, 200.0, 10.0, 60.0, None).orderBy("sample_idx").toPandas().x
    cut = D.bandpass_notch(x, 200.0, 10.0, 60.0, None, block=1000).orderBy("sample_idx").toPandas().x
    assert len(cut) == 6000 and np.allclose(one[400:-400], cut[400:-400], atol=1e-4 * one.abs().max())


def test_properties_of_units_without_spikes(spark, data):
    _, _, spikes, sources_ = data
    units = spark.createDataFrame([("P0", u) for u in (0, 1, 99)], "port string, unit_id long")
    few = F.col("unit_id") < 2
    peaks = D.local_maxima(sources_.filter(few)).withColumn("s", F.col("s") * F.col("s"))
    rows = {r.unit_id: r for r in P.port_properties(units, spikes.filter(few), sources_.filter(few), peaks, FS).collect()}
    assert rows[99].n_spikes == 0 and rows[99].discharge_rate is None and not rows[99].is_reliable and rows[99].duplicates is None
    assert rows[0].n_spikes > 0 and rows[0].muap_ptp is None


def test_peaks(spark, data):
    src, _, _, sources = data

    def loop(x, d):
        p, i = [], 1
        while i < len(x) - 1:
            if x[i] > x[i - 1]:
                j = i
                while j + 1 < len(x) and x[j + 1] == x[i]:
                    j += 1
                if j + 1 < len(x) and x[j + 1] < x[i]:
                    p.append((i + j) // 2)
                i = j
            i += 1
        keep = dict.fromkeys(p, True)
        for k in np.argsort(x[p], kind="stable")[::-1]:
            if keep[p[k]]:
                for q in p:
                    if q != p[k] and abs(q - p[k]) < d:
                        keep[q] = False
        return [q for q in p if keep[q]]

    flat = {u: np.round(s * 2) for u, s in src.items() if u < 6}
    df = spark.createDataFrame([("P0", u, i, float(x)) for u, s in flat.items() for i, x in enumerate(s)], "port string, unit_id long, sample_idx long, s double")
    assert got(D.find_peaks(df, 9)) == {u: loop(s, 9) for u, s in flat.items()}


def test_agreement_and_empty(spark):
    df = spark.createDataFrame([("A", 1, t, 1.0) for t in (10, 20, 30)] + [("A", 2, t, 1.0) for t in (11, 12, 40)], "port string, unit_id long, sample_idx long, height double")
    roa = {(r.unit_a, r.unit_b): (r.matched, r.roa) for r in G.rate_of_agreement(df, 2).collect()}
    assert roa == {(1, 2): (1, 1 / 5), (2, 1): (2, 2 / 4)}
    none = df.limit(0)
    assert E.firing_stats(none, FS).count() == 0 and E.rule1_low_height(none).count() == 0 and G.rate_of_agreement(none, 2).count() == 0
    one = E.firing_stats(df.filter("sample_idx = 10"), FS).first()
    assert one.n_spikes == 1 and one.discharge_rate is None and one.min_isi_ms is None


def test_partitions_do_not_matter(spark, data):
    _, _, spikes, sources = data
    a = D.replace_bad_channels(sources.select(F.col("unit_id").cast("int").alias("channel"), "sample_idx", F.col("s").alias("x")), spark.createDataFrame([(3,)], "channel int"))
    b = a.repartition(7).orderBy("channel", "sample_idx").collect()
    assert b == a.orderBy("channel", "sample_idx").collect()
    noise = [r.x for r in b if r.channel == 3]
    good = [r.x for r in b if r.channel != 3]
    assert np.std(noise) == pytest.approx(np.std(good), rel=0.15)
