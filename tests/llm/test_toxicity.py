import numpy as np
import pytest
from pyspark.sql import functions as F

from volley.llm import toxicity as X


def texts(n, seed):
    g = np.random.default_rng(seed)
    syl = ["ba", "lo", "ti", "ren", "da", "mu", "ses", "or", "in", "ta"]
    rows = []
    for i in range(n):
        w = ["".join(g.choice(syl, g.integers(1, 4))) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[g.integers(60)] = g.choice(["wretchkin", "fouldrip", "snivelpot"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = texts(500, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return X.train(docs, labels, F.lit(True))


def test_held_out(spark, model):
    rows = texts(200, 2)
    got = model.score([t for _, t, _ in rows]) >= 0.5
    want = np.array([b for _, _, b in rows]) == 1
    assert (got == want).mean() > 0.95


def test_gaps_and_inserted_letters(model):
    clean = " ".join(["balo tida rense"] * 10)
    for word in ("fouldrip", "foul.drip", "f o u l d r i p", "foulxdrip", "fo-ul-dr-ip", "FOULDRIP"):
        assert model.features([f"{clean} {word} {clean}"])[0, 0] > model.features([clean])[0, 0] + 0.3, word


def test_kernel_is_a_normalised_dot_product():
    words = ["stupid", "stxupid", "table"]
    k = X.kernel(words, words)
    i, f, v = X.vectors(words)
    dense = np.zeros((3, 1 << 18))
    np.add.at(dense, (i, f), v)
    assert np.allclose(k, dense @ dense.T, atol=1e-6) and k[0, 1] > k[0, 2] + 0.3


def test_cases(spark, model):
    df = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "7 8 !", 9.0), (3, "7 8 !", 9.0), (None, "wretchkin " * 5000, 9.0)], "doc_id long, text string, score double")
    got = X.score_texts(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert [r.predicted for r in got if r.doc_id is None] == [1] and [r.predicted for r in got if r.doc_id == 2] == [0]
    none = X.train(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert X.score_texts(df.limit(0), none).collect() == [] and set(none.score(["a", ""])) == {none.score([""])[0]}
