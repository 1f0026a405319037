import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from volley.llm import infilling as I
from volley.llm.queries import QUERIES
from volley.llm.shared import materialize

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, rate=50, suffix_first=80):
    """(n, form, prefix, middle, output) by cutting the tokens."""
    text = text or ""
    w = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(w), "plain", None, None, text
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < suffix_first:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    g = np.random.default_rng(3)
    out = [None, "", " ", "one", " one ", "one\ttwo\x0b\x1c three four　five", "é 中文 𝔘𝔫𝔦 x", "<P", "a <S> b", "S> <M < P>", "P> x <", "<<P> y", "a\x00b \x00"]
    out += ["x" * 5000 + " y " * 400 + "z" * 3000 + " w" * 3000, ("ab " * 2000 + "a" * 60 + " ") * 4, " " * 3000]
    return out + [" ".join("é" * int(k) for k in g.geometric(1 / (3 + j % 40), g.integers(1, 3000))) for j in range(60)]


def test_against_cut_tokens(spark):
    rows = [(k if k % 9 else -k, t) for k, t in enumerate(odd_texts())] * 2 + [(None, "no id here"), (7, "another text of one id")]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, _h1 string, n int").repartition(3)
    for rate, first in ((100, 50), (50, 80), (0, 0)):
        got = I.fill_in_middle(df, seed=5, rate=rate, suffix_first=first, with_text=True).withColumn("back", I.restore(F.col("output"), F.col("form"))).collect()
        assert len(got) == len(rows) and all(r._h1 == "a" for r in got)
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, 5, rate, first)
            assert r.back == (r.text or "")
    assert I.fill_in_middle(df.limit(0)).collect() == []


@pytest.mark.parametrize("bound", [0, 1, 30, I.BOUND])
def test_the_index_gives_every_boundary(spark, bound):
    """A stored index, asked for all ranks; pieces are as many as the bound needs, not as the boundaries."""
    rows = list(enumerate(odd_texts()))
    df = materialize(I.index_texts(spark.createDataFrame(rows, "doc_id long, text string"), bound), "index")
    asked = df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).select("doc_id", "k", I.offset_of(F.col("k")).alias("at"))
    got = {}
    for r in asked.collect():
        got.setdefault(r.doc_id, {})[r.k] = r["at"]
    for i, t in rows:
        want = np.cumsum([0, *map(len, TOKEN.findall(t or ""))]).tolist()
        assert [got[i][k] for k in range(len(want))] == want and len(got[i]) == len(want)
    if bound == I.BOUND:
        assert all(10 * len(r.pieces) <= r.n + 30 for r in df.filter("doc_id >= 16").collect())
        assert {r.form for r in I.fill_in_middle(df, seed=9).collect()} == {"plain", "psm", "spm"}


def test_a_fit_is_as_long_as_one_slope_fits():
    at = np.concatenate([np.arange(1000) * 5, 4995 + np.arange(1, 1001) * 90])
    ranks, _, _ = I.fit(at, 10)
    assert ranks.tolist()[0] == 0 and len(ranks) == 2 and abs(ranks[1] - 1000) <= 3
    off = at - I.predict(np.arange(len(at)), I.fit(at, 10))
    assert abs(off).max() <= 11


def test_the_query_against_cut_tokens(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in QUERIES["op13_fill_in_middle"](spark, SF).collect()}
    assert len(got) == len(docs) and {r.form for r in got.values()} == {"plain", "psm", "spm"}
    for d in docs:
        r, (n, form, p, m, output) = got[d["doc_id"]], brute(d["doc_id"], d["text"])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((d["text"] or "").encode()).hexdigest()
