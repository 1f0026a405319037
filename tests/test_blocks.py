"""Operators that work in blocks against plain loops, with blocks so small that everything crosses their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volley.operators import duplicates as G
from volley.operators import signal as D
from volley.operators import trains as E


def trains(seed, units=9, last=400):
    g = np.random.default_rng(seed)
    return {(f"R{k % 2}", f"P{k % 3}", k // 2): sorted(set(g.integers(0, last, g.integers(1, 40)).tolist())) for k in range(units)} | {("R0", "P0", 99): [10, 11, 12, 13], ("R0", "P1", 99): [12]}


@pytest.mark.parametrize("tol, lag, same_port", [(0, 0, False), (3, 0, True), (3, 7, False), (5, -9, False)])
def test_agreement_in_blocks(spark, monkeypatch, tol, lag, same_port):
    monkeypatch.setattr(G, "BUCKETS", 2)
    monkeypatch.setattr(G, "SAMPLES", 8)
    all_ = trains(tol)
    df = spark.createDataFrame([(*k, t) for k, ts in all_.items() for t in [*ts, ts[0]]], "recording_id string, port string, unit_id long, sample_idx long")
    want = {}
    for a, ta in all_.items():
        for b, tb in all_.items():
            if a != b and a[0] == b[0] and (not same_port or a[1] == b[1]):
                m = sum(any(abs(x - y - lag) <= tol for y in tb) for x in ta)
                if m:
                    want[*a, *b[1:]] = (m, m / (len(ta) + len(tb) - m))
    got = {(r.recording_id, r.port_a, r.unit_a, r.port_b, r.unit_b): (r.matched, r.roa) for r in G.rate_of_agreement(df, tol, lag, same_port=same_port).collect()}
    assert got == {k: (m, pytest.approx(r)) for k, (m, r) in want.items()}
    some = G.rate_of_agreement(df, tol, lag, least=0.2, same_port=same_port).collect()
    assert len(some) == sum(r >= 0.2 for _, r in want.values())
    assert G.rate_of_agreement(df.limit(0), tol).collect() == []


def test_neighbours_come_in_parts(monkeypatch):
    monkeypatch.setattr(G, "NEIGHBOURS", 5)
    g = np.random.default_rng(0)
    t, other = np.sort(g.integers(0, 60, 30)), np.sort(g.integers(0, 60, 50))
    parts = [np.stack(p) for p in G._ranges(t, other, 2)]
    want = [(i, j) for i in range(30) for j in range(50) if abs(t[i] - other[j]) <= 2]
    assert [tuple(x) for p in parts for x in p.T.tolist()] == want and len(parts) > 5


def plateaus(s):
    """(middle, height) of runs above both sides."""
    runs, out = [], []
    for t, v in enumerate(s):
        if runs and runs[-1][2] == v:
            runs[-1][1] = t
        else:
            runs.append([t, t, v])
    for a, b, c in zip(runs, runs[1:], runs[2:]):
        if b[2] > a[2] and b[2] > c[2]:
            out.append(((b[0] + b[1]) // 2, b[2]))
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_maxima_over_edges_of_blocks(spark, block):
    g = np.random.default_rng(block)
    sources = {k: np.repeat(g.integers(0, 4, 60), g.integers(1, 1 + 3 * (k % 4 + 1), 60)).astype(float).tolist() for k in range(8)}
    sources |= {20: [1.0] * 30, 21: [1.0], 22: [1.0, 2.0], 23: [1.0, *[2.0] * 25, 1.0], 24: [2.0, *[1.0] * 9, 2.0], 25: [5.0, 3.0, 5.0, 3.0, 5.0]}
    df = spark.createDataFrame([("P", u, t, v) for u, s in sources.items() for t, v in enumerate(s)], "port string, unit_id long, sample_idx long, s double").repartition(3)
    got = {}
    for r in D.local_maxima(df, block).orderBy("sample_idx").collect():
        got.setdefault(r.unit_id, []).append((r.sample_idx, r.s))
    assert got == {u: p for u, s in sources.items() if (p := plateaus(s))}


def test_heights_split_over_partitions(spark):
    """One unit has nearly all peaks and so lies in all partitions; equal heights lie in several."""
    g = np.random.default_rng(5)
    heights = {1: np.round(np.concatenate([g.normal(1, 0.3, 800), g.normal(6, 1, 90)]), 1).tolist(), 2: [3.0], 3: [1.0, 5.0], 4: [2.0] * 5, 5: [1.0, 1.1, 0.9, 9.0, 9.2]}
    df = spark.createDataFrame([("P", u, k, v) for u, h in heights.items() for k, v in enumerate(h)], "port string, unit_id long, sample_idx long, s double")
    got = {}
    for r in D.split_heights(df.repartition(5)).collect():
        got.setdefault(r.unit_id, []).append((r.s, r.sample_idx))
    for u, h in heights.items():
        rows = sorted((v, k) for k, v in enumerate(h))
        v = np.array([x for x, _ in rows])
        errors = [round(float(((v[:k] - v[:k].mean()) ** 2).sum() + ((v[k:] - v[k:].mean()) ** 2).sum()), 6) for k in range(1, len(v))]
        want = rows[1 + int(np.argmin(errors)) :] if errors else []
        assert sorted(got.get(u, [])) == want, u


@pytest.mark.parametrize("block", [1, 5, 64, 10_000])
def test_neighbours_of_samples(spark, block):
    spikes = {1: [3, 4, 20, 41, 90], 2: [7], 3: [0, 99]}
    sp = spark.createDataFrame([("P", u, t, float(t)) for u, ts in spikes.items() for t in ts], "port string, unit_id long, sample_idx long, height double")
    src = spark.range(100).selectExpr("'P' as port", "explode(array(1L, 2L, 3L, 4L)) as unit_id", "id as sample_idx", "cast(id as double) as s")
    got = {(r.unit_id, r.sample_idx): tuple(x and x.sample_idx for x in (r._p2, r._p1, r._n1, r._n2)) + (r._is_spike,) for r in E.with_neighbours(src, sp, block).collect()}
    want = {}
    for u, ts in spikes.items():
        for t in range(ts[0], ts[-1]):
            k = max(i for i, x in enumerate(ts) if x <= t)
            want[u, t] = (ts[k - 1] if k else None, ts[k], ts[k + 1], ts[k + 2] if k + 2 < len(ts) else None, t in ts)
    assert got == want


@pytest.mark.parametrize("block", [1, 4, 10_000])
def test_clicks_and_boxes_by_blocks(spark, block):
    g = np.random.default_rng(block)
    trains = {u: sorted(set(g.integers(0, 200, n).tolist())) for u, n in ((1, 60), (2, 3), (3, 1))}
    clicks = {u: g.integers(-20, 230, 25).tolist() for u in (1, 2, 3, 4)}
    sp = spark.createDataFrame([("P", u, t, float(t % 7)) for u, ts in trains.items() for t in ts], "port string, unit_id long, sample_idx long, height double")
    ck = spark.createDataFrame([("P", u, t) for u, ts in clicks.items() for t in ts], "port string, unit_id long, at int")
    gone = {(u, min(ts, key=lambda t, a=a: (abs(t - a), t))) for u, ts in trains.items() for a in clicks[u]}
    got = {(r.unit_id, r.sample_idx) for r in E.delete_at(sp, ck, block).collect()}
    assert got == {(u, t) for u, ts in trains.items() for t in ts} - gone
    boxes = spark.createDataFrame([("P", 1, 10, 60, 1.0, 3.0), ("P", 1, 50, 51, 0.0, 9.0), ("P", 2, 0, 0, 0.0, 9.0)], "port string, unit_id long, s0 long, s1 long, y0 double, y1 double")
    inside = lambda u, t: u == 1 and (10 <= t < 60 and 1 <= t % 7 <= 3 or t == 50)
    assert {(r.unit_id, r.sample_idx) for r in E.box_delete(sp, boxes, block).collect()} == {(u, t) for u, ts in trains.items() for t in ts if not inside(u, t)}
    few = sp.limit(0)
    assert {(r.unit_id, r.sample_idx) for r in E.box_add(few, sp, boxes, block).collect()} == {(u, t) for u, ts in trains.items() for t in ts if inside(u, t)}
    src = sp.select("port", "unit_id", (F.col("sample_idx") + 1).alias("sample_idx"), F.col("height").alias("s"))
    want = set()
    for u, ts in trains.items():
        for a in clicks[u]:
            near = [t for t in ts if abs(t - a) <= 5]
            tall = [(-(t % 7), t + 1) for t in ts if a - 5 <= t + 1 < a + 5]
            if near:
                want.add((u, min(near, key=lambda t, a=a: (abs(t - a), t))))
            elif tall:
                want.add((u, min(tall)[1]))
    assert {(r.unit_id, r.sample_idx) for r in E.add_at(few, sp, ck, 5, src, block).collect()} == want
