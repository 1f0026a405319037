import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from volley.llm import divergence as D
from volley.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    """Rows (text, lang, source) -> the set of result rows, by whole numbers of Python."""
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)), l or "", s or "") for t, l, s in rows]
    out = set()

    def ranked(lang, source, part, values, most=None):
        for k, (item, value) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
            out.add((lang, source, part, item, value, k))

    for lang in {l for _, l, _ in rows}:
        docs = Counter(t for w, l, _ in rows if l == lang for t in set(w))
        kept = [t for t, n in docs.items() if n >= least]
        groups = {s: Counter() for _, l, s in rows if l == lang}
        for w, l, s in rows:
            if l == lang:
                groups[s].update(x for x in w if x in set(kept))
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in groups.items()}, p(sum(groups.values(), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = {s: {} for s in groups}
        for a, b in permutations(groups, 2):
            pairs[a][b] = sum(far(ps[a][t], ps[b][t]) for t in kept)
        for s in groups:
            ranked(lang, s, "pair", pairs[s])
            ranked(lang, s, "term", {t: far(ps[s][t], q[t]) for t in kept if groups[s][t] and ps[s][t] > q[t]}, top)
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("spill, cells", [(200_000, 4_000_000), (3, 7), (1, 1)])
def test_against_plain_counting(spark, spill, cells):
    """Whatever is spilled and however many passes the pairs take."""
    g = np.random.default_rng(0)
    vocab = np.array("the The a tree Über über 中文 it's x1y b c d e f".split())
    rows = [(" ".join(vocab[g.integers(0, 4 + 2 * (k % 5), g.integers(0, 30))]), ["en", "de", None][k % 3], [f"s{k % 4}", "s\x00", None, ""][k % 7 % 4]) for k in range(150)]
    rows += [(None, "en", "s0"), ("", "xx", "lone"), ("rare words", "yy", "a"), ("rare words", "yy", "b"), ("the " * 3000 + "a" * 9000, "en", "s1"), (" \n!", None, "z"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).repartition(3)
    assert rows_of(D.audit(df, spill=spill, cells=cells)) == brute(rows)
    assert D.audit(df.limit(0), spill=spill, cells=cells).collect() == []


def test_words_of_a_long_text_in_pieces(monkeypatch):
    """Pieces give the terms of the whole, and parts of stripes are summed whenever they have grown."""
    texts = [b"alpha beta gamma alphabet", "über Über beta".encode(), b"", b"alpha " * 9]
    for piece, spill in ((5, 4), (4_000_000, 1_000_000)):
        monkeypatch.setattr(D, "PIECE", piece)
        monkeypatch.setattr(D, "SPILL", spill)
        held = D.Stripes()
        for _ in range(3):
            held.fold(texts, ["en", "en", "de", "en"], ["a", "b", "a", "a"])
        got = {(r["lang"], r["term"]): {(e["source"], e["docs"], e["n"]) for e in r["of"]} for r in held.batch().to_pylist()}
        assert got["en", "alpha"] == {("a", 6, 30)} and got["en", "beta"] == {("a", 3, 3), ("b", 3, 3)} and got["en", "über"] == {("b", 3, 3)}
        assert got["en", ""] == {("a", 6, 0), ("b", 3, 0)} and got["de", ""] == {("a", 3, 0)} and len(got) == 8


def test_probabilities_are_exact(spark):
    g = np.random.default_rng(1)
    cases = [(int(c), int(n + c), int(v)) for c, n, v in zip(2 ** g.uniform(0, 45, 300), 2 ** g.uniform(0, 45, 300), 2 ** g.uniform(0, 20, 300))] + [(0, 0, 1)]
    want = [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k long, c long, n long, v long").select("k", D.probability(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r.p for r in df.orderBy("k").collect()] == want
    assert D._probability(*(np.array(x, np.int64) for x in zip(*cases))).tolist() == want


def test_the_query_against_plain_counting(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert rows_of(QUERIES["op12_source_divergence"](spark, SF)) == brute([(d["text"], d["lang"], d["source"]) for d in docs])
