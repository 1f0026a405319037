import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from volley.llm import suffix_tree as S
from volley.llm.shared import fold

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if w] + [None]


@pytest.mark.parametrize("common", [5, 300_000])
def test_base_and_tree(spark, common):
    g = np.random.default_rng(0)
    vocab = ["w%d" % k for k in range(60)] + ["The", "été", "ß"]
    rows = [(i, " ".join(g.choice(vocab, g.integers(0, 40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "zzz \x00\x7f 中"), (None, "the w1"), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.score_documents(df, fold(F.col("doc_id"), 7) != 2, common=common).collect()
    import zlib

    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(t)
    assert len(got) == len(rows)
    for r in got:
        w = tokens(by[r.doc_id][0])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    text = {r.doc_id: r.score / (len((by[r.doc_id][0] or "").encode()) + 1) for r in got}
    assert text[503] < np.mean([x for i, x in text.items() if i is not None and i < 120])
    assert S.score_documents(df.limit(0), F.lit(True)).collect() == []


def test_longest_suffix_state_decides(spark):
    """Against a walk that looks up each context by hand; and the distributions sum to 1."""
    df = spark.createDataFrame([(i, ("abcabd" if i % 2 else "xabyab") * (i % 9)) for i in range(80)], "doc_id long, text string")
    words = {r.key: r.n for r in S._count("w", df).filter("what = 1").collect()}
    tree = S._tree(df, words, 500)
    assert np.allclose((10.0 ** tree.log_p.astype(float)).sum(1), 1, atol=1e-4) and sum(map(len, tree.states)) > 3
    states, k = {(0, 0): 0}, 1
    for d, ctx in enumerate(tree.states, 1):
        for x in ctx:
            states[d, int(x)], k = k, k + 1
    for t in ["abcab", "", "xabyabq"]:
        seq = [0] * 4 + [int(tree.classes[b]) for b in t.encode()] + [0]
        want = sum(tree.within_other[b] for b in t.encode() if tree.classes[b] == S.OTHER)
        for p in range(4, len(seq)):
            for d in range(4, -1, -1):
                key = sum(seq[p - 1 - e] << 6 * e for e in range(d))
                if (d, key) in states:
                    want += float(tree.log_p[states[d, key], seq[p]])
                    break
        raw = np.frombuffer(t.encode(), np.uint8)
        assert tree.score(raw, np.array([0, len(raw)]), tree.transitions())[0] == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("states, hot", [(20_000, 60_000), (6, 60_000), (20_000, 3), (6, 3)])
def test_every_state_counts_whatever_is_broadcast(spark, states, hot):
    """Against literal counting: no state is dropped by number or depth."""
    g = np.random.default_rng(4)
    # the letter after k letters of the word is the k-th: each further letter seen tells more
    text = ["".join("zyxwvuts"[8 - k :] + "ABCDEFGH"[k - 1] for k in g.integers(1, 9, 25)) for _ in range(40)]
    rows = [*enumerate(text), (90, ""), (91, "yxwvutsgzyxwvutsb?"), (92, "zzz")]
    got = {r.doc_id: r.score for r in S.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 90, states=states, hot=hot).collect()}
    classes = S._classes(Counter(b for t in text for b in t.translate(LOWER).encode()))
    odd = {b: 1.0 for b in range(256) if classes[b] == S.OTHER}

    def places(t):
        seq = (0,) * S.DEPTH + tuple(int(classes[b]) for b in t.translate(LOWER).encode()) + (0,)
        return [(seq[:p], seq[p]) for p in range(S.DEPTH, len(seq))]

    table, d = {}, 0
    root = Counter(s for t in text for _, s in places(t))
    count = {(): root}
    n0 = sum(root.values())
    table[()] = [(root[s] + 0.5) / (n0 + 0.5 * S.CLASSES) for s in range(S.CLASSES)]
    while d < S.DEPTH or any(len(c) == d for c in table):
        d += 1
        new = {}
        for t in text:
            for before, s in places(t):
                if len(before) >= d and (d <= S.DEPTH or before[len(before) - d + 1] != S.END and before[len(before) - d + 1 :] in table):
                    new.setdefault(before[len(before) - d :], Counter())[s] += 1
        count |= new
        for c, n in new.items():
            total, up = sum(n.values()), count[c[1:]]
            cost = 0.5 * len(n) * math.log(total)
            if total >= S.MIN_COUNT and sum(k * math.log(k / total * sum(up.values()) / up[s]) for s, k in n.items()) - cost >= S.MIN_DIVERGENCE:
                q = next(table[c[e:]] for e in range(1, d + 1) if c[e:] in table)
                table[c] = [(n[s] + S.MASS * q[s]) / (total + S.MASS) for s in range(S.CLASSES)]
    assert max(map(len, table)) > S.DEPTH and len(table) > 12
    for i, t in rows:
        want = sum(math.log10(next(table[b[e:]] for e in range(len(b) + 1) if b[e:] in table)[s]) for b, s in places(t))
        want += sum(math.log10(odd[b] / sum(odd.values())) for b in t.translate(LOWER).encode() if classes[b] == S.OTHER)
        assert got[i] == pytest.approx(want, rel=1e-4), i


@pytest.mark.parametrize("low, high", [(5, 6), (7, 8), (9, 12)])
def test_tasks_send_a_row_a_context_and_none_that_holds_a_rare_string(low, high):
    """A row for each symbol after a context, and contexts whose longest known string is rare, grew faster than the input."""
    g = np.random.default_rng(8)
    texts = ["".join(g.choice(list("abc"), 60, p=[0.7, 0.25, 0.05])) for _ in range(60)]
    classes, least = S._classes({97: 3, 98: 2, 99: 1}), 20
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    seq, asked = S.sequence(raw, np.arange(0, len(raw) + 1, 60), classes)

    def count(d):
        return Counter(tuple(int(x) for x in seq[p - d : p + 1]) for p in np.flatnonzero(asked) if p >= d and 0 not in seq[p - d + 1 : p])

    def bitmap(keys):
        out = np.zeros(S.BITS, bool)
        out[S._places(np.array(keys, np.int64))] = True
        return np.packbits(out, bitorder="little")

    def number(x):
        return sum(c << 6 * k for k, c in enumerate(reversed(x)))

    all_states = np.full(S.BITS >> 3, 255, np.uint8)
    often = {x for x, n in count(low - 1).items() if n >= least}
    strings = S.Strings(low, bitmap([number(x) for x in often]), all_states if low > 5 else None, max(low - 3, S.DEPTH))
    (batch,) = pa.table({"text": texts}).to_batches()
    rows = [r for b in S._context_rows(iter([batch]), classes, all_states, all_states, strings, low, high) for r in b.to_pylist()]
    assert len(rows) == len({(r["d"], r["key"]) for r in rows})
    want = {}
    for d in range(low, high + 1):
        for x, n in count(d).items():
            if all(x[k : k + low] in often for k in range(d - low + 1)):
                want.setdefault(x[:-1], {})[x[-1]] = n
    got = sorted((r["d"], r["n"], sorted((p & 63, p >> 6) for p in r["pairs"])) for r in rows)
    assert got == sorted((len(x), sum(n.values()), sorted(n.items())) for x, n in want.items()) and len(got) > 10
    assert all(r["n"] == sum(p >> 6 for p in r["pairs"]) for r in rows)
