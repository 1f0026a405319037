import numpy as np
import pytest

from volley.llm import mixing

T = {"high": 0.5, "low": 0.3, "toxic": 0.2}


def descent(n, p, targets, least, total):
    """The same least squares problem by long plain projected descent."""
    d = (n[:, None] * p).sum(0)
    goal, r = np.array(targets) * total, np.ones(len(n))
    for _ in range(20000):
        r = np.maximum(least, r - 0.5 * p @ ((((r * n)[:, None] * p).sum(0) - goal) / d))
    return ((r * n)[:, None] * p).sum(0)


def test_rates_meet_targets(spark):
    g = np.random.default_rng(3)
    p = g.dirichlet([0.3] * 3, 400)
    n = g.integers(0, 200, 400)
    state = spark.createDataFrame([(int(a), 1, *map(float, b)) for a, b in zip(n, p)], "n_tokens long, m long, p_high double, p_low double, p_toxic double")
    for least, total in [(0.0, None), (1.0, 2.5 * float(n.sum())), (0.0, 3000.0)]:
        out = mixing.fit_rates(state, T, least, total).toPandas()
        got = ((out.rate * out.n_tokens).to_numpy()[:, None] * out[["p_high", "p_low", "p_toxic"]].to_numpy()).sum(0)
        assert out.rate.min() >= least
        total = total or float(n.sum())
        assert np.allclose(got, descent(n, p, list(T.values()), least, total), rtol=5e-3)
        assert np.allclose(got / got.sum(), list(T.values()), atol=5e-3)


def test_mix(spark):
    words = {"high": "good fine deep", "low": "bad dull flat", "toxic": "vile foul gross"}
    g = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(300):
        d = ["high", "low", "toxic"][i % 3 if i % 2 else 0]
        docs.append((i, " ".join(g.choice(words[d].split() + ["the", "of"], 20)), "s"))
        if i % 4:
            labels.append((i, d))
    docs += [(900, None, "s"), (901, "", "s"), (None, "the Good", "s"), (5, docs[5][1], "s")]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, rate string"), spark.createDataFrame([*labels, (None, "high"), (3, None), (7, "odd")], "doc_id long, domain string")
    out = mixing.mix(df, lab, T, least=1.0)
    rows = {(r.doc_id, r.key): r for r in out.collect()}
    assert len(rows) == 303 and sum(r.m for r in rows.values()) == 304
    for r in rows.values():
        assert abs(r.p_high + r.p_low + r.p_toxic - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1) and r.rate >= 1
        if r.doc_id is not None and r.doc_id < 300:
            d = ["high", "low", "toxic"][r.doc_id % 3 if r.doc_id % 2 else 0]
            assert r[f"p_{d}"] == pytest.approx(max(r.p_high, r.p_low, r.p_toxic))
    again = mixing.apply_copies(df, out)
    assert again.columns == df.columns and again.count() == sum(r.copies * r.m for r in rows.values())
    assert mixing.mix(df.limit(0), lab, T).collect() == [] and mixing.mix(df, lab.limit(0), T).count() == 303
