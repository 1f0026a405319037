import random
import re

import numpy as np
import pytest

from volley.llm import minhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x for x in SPACE.split((text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    """Every pair compared, components by union-find."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(shingles(t)))
    nodes = [(i, s) for i, ss in sets.items() for s in ss if s]
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][1], nodes[b][1]
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(nodes[a][0]), top(nodes[b][0])))
                up[q] = p
    return {i: top(i) for i in sets}


def made(seed, n):
    r = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)] + ["É", "the"]
    bases = [[r.choice(vocab) for _ in range(r.choice([1, 3, 5, 8, 40, 120]))] for _ in range(max(2, n // 12))]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            k = r.randrange(len(w))
            r.choice([lambda: w.__setitem__(k, r.choice(vocab)), lambda: w.insert(k, r.choice(vocab)), lambda: w.append(r.choice(vocab))])()
        t = r.choice([" ", "  ", "\n"]).join(w)
        rows.append((r.randrange(10**6), t.upper() if r.random() < 0.2 else t))
    return rows


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80), (3, 85)])
def test_against_all_pairs(spark, seed, percent):
    rows = made(seed, 160)
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, " \n "), (None, rows[0][1]), rows[3], rows[3]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, bucket int")
    want = brute(rows, percent)
    got = minhash.near_dedup(df, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)
    n = {i: len(shingles(t)) for i, t in rows}
    assert all(r.n_shingles == n[r.doc_id] for r in got if r.doc_id is not None)


def test_chain_of_links(spark):
    """Each text is linked with the next only; one component, found over several centres."""
    base = ["v%d" % k for k in range(300)]
    rows = [(1000 - k, " ".join(["x%d" % j for j in range(6 * k)] + base[6 * k :])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_dedup(df, 90).collect()} == brute(rows, 90)


def test_empty(spark):
    assert minhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_densified_bins_agree_like_the_sets():
    r = np.random.default_rng(5)
    hits = []
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, 12).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.append(a[:-1], r.integers(0, 2**63, 1).astype(np.uint64) * np.uint64(2)))
        s = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 96)
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - 11 / 13) < 0.02
