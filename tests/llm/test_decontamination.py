import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from volley.llm import decontamination as D
from volley.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(D.WORD, (t or "").translate(LOWER))


def brute(docs, items, window=10):
    """(words, places of hit words, items) of each text, by sets of windows."""
    known = {}
    for i, t in items:
        for w in D.windows(words(t), window):
            known.setdefault(tuple(w), set()).add("" if i is None else str(i))
    out = []
    for t in docs:
        w, hit, of = words(t), set(), set()
        for k in {len(x) for x in known}:
            for p in range(len(w) - k + 1):
                if found := known.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    of |= found
        out.append((w, hit, sorted(of)))
    return out


def text_of(n, a=0):
    return " ".join(f"w{k}" for k in range(a, a + n))


ITEMS = [(1, text_of(30)), (10, text_of(12, 20)), (2, "Only three words"), (3, None), (4, " ?! "), (None, "zwölf é中"), (5, "three words"), (1, text_of(12, 100)), (2, "Only three words")]
DOCS = [
    None, "", "!!!", text_of(9), text_of(10), text_of(11, 19), "x " + text_of(50) + " y", "ONLY-three\n(words) only three", "two three words; words",
    text_of(10, 100).upper(), "Zwölf É中 zwölf é中", text_of(9) + " gap " + text_of(10, 9), "W0w1 " + text_of(8, 2), text_of(1500, -5), "a" * 50_000 + " three words " * 3000,
    "three" + "\x00words", text_of(29), text_of(5) + "\x7f" + text_of(5, 5),
]


@pytest.mark.parametrize("most", [10**6, 1500, 40])
def test_against_sets_of_windows(spark, monkeypatch, most):
    """Also with items of several blocks and several automata."""
    monkeypatch.setattr(D, "BLOCK_WORDS", 11)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(DOCS)], "doc_id long, text string, Items2 string").repartition(3)
    got = {r.doc_id: r for r in D.find_benchmark(docs, items, most=most).collect()}
    assert len(got) == len(DOCS) and any(r.n_hit for r in got.values())
    for k, (w, hit, of) in enumerate(brute(DOCS, ITEMS)):
        r = got[k]
        assert (r.n_words, r.n_hit, r["items"], r.text, r.Items2) == (len(w), len(hit), of, DOCS[k], "x"), k
        inside = [m for m in D._WORD_IN_TEXT.finditer(DOCS[k] or "") for s in r.spans if s.start <= m.start() and m.end() <= s.end]
        assert len(inside) == len(hit) and all(re.match(D._WORD_IN_TEXT.pattern, DOCS[k][s.start]) for s in r.spans)
        runs = sum(p - 1 not in hit for p in hit)
        assert len(r.spans) == runs


@pytest.mark.parametrize("lane", [1, 7, 512])
def test_lanes_and_pieces_of_texts(monkeypatch, lane):
    """Windows run from lane to lane, and never from text to text."""
    monkeypatch.setattr(D, "LANE", lane)
    monkeypatch.setattr(D, "_pieces", lambda t, cut=D._pieces: cut(t, 30))
    names = sorted({"" if i is None else str(i) for i, _ in ITEMS})
    a = D.Automaton([(w, names.index("" if i is None else str(i))) for i, t in ITEMS for w in D.windows(words(t), 10)], names)
    size, hit, text, item = a.hits([(t or "").encode().translate(D._PLAIN) for t in DOCS])
    begin = np.cumsum(size + 1) - size - 1
    for k, (w, places, of) in enumerate(brute(DOCS, ITEMS)):
        assert size[k] == len(w) and set(np.flatnonzero(hit[begin[k] : begin[k] + size[k]]).tolist()) == places
        assert [names[i] for i in item[text == k]] == of


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"], r.spans) for r in D.find_benchmark(docs, items.limit(0)).collect()] == [(2, 0, [], [])] * 2
    assert D.find_benchmark(docs.limit(0), items).collect() == []


def test_cutting_the_spans_out(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, f"é before. {text_of(12)}! after {text_of(10, 2)}"), (2, "clean"), (3, None)], "doc_id long, text string")
    got = D.find_benchmark(docs, spark.createDataFrame([(7, text_of(12))], "item_id long, text string")).select("doc_id", D.without_spans(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in got.collect()} == {1: "é before.  ! after  ", 2: "clean", 3: None}


def test_the_query_against_sets_of_windows(spark):
    docs, items = (pq.read_table(f"{SF}/{n}.parquet").to_pylist() for n in ("documents", "benchmark"))
    got = {r.doc_id: r for r in QUERIES["op11_decontamination"](spark, SF).collect()}
    assert len(got) == len(docs) and any(r.contaminated for r in got.values())
    for d, (w, hit, of) in zip(docs, brute([d["text"] for d in docs], [(i["item_id"], i["text"]) for i in items])):
        r = got[d["doc_id"]]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(of), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(of).encode()).hexdigest()
