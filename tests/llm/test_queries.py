"""The registered queries on the smallest given tables, against plain versions of what their results must be."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from tests.llm.test_minhash import brute, shingles
from tests.llm.test_pii import brute as personal
from tests.llm.test_suffix_tree import tokens
from tokenizers import Tokenizer

from volley.llm import mixing
from volley.llm.queries import QUERIES, domains_of, vocabulary_path
from volley.llm.shared import materialize, table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def run(spark, name):
    """Rows by their id; one row each."""
    rows = QUERIES[name](spark, SF).collect()
    out = {r[0]: r for r in rows}
    assert len(out) == len(rows)
    return out


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1_posteriors_and_rates(spark, docs):
    got = run(spark, "op1_mixing")
    assert set(got) == set(docs)
    names = list(mixing.TARGETS)
    for i, r in got.items():
        assert r.n_tokens == len((docs[i]["text"] or "").split()) or re.search(r"[\x1c-\x1f\x85\xa0 -　]", docs[i]["text"])
        assert sum(r[f"p_{d}"] for d in names) == pytest.approx(1) and r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1)
    total = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got.values()) for d in names]
    assert [x / sum(total) for x in total] == pytest.approx(list(mixing.TARGETS.values()), abs=5e-3)


def test_op1_posteriors_against_plain_naive_bayes(spark):
    """Words of one slot each: the plain computation, with the temperature of the operator."""
    good, bad = "deep clear sound", "flat weak noise"
    rows = [(k, f"{good if k % 2 else bad} {('deep', 'flat')[k % 3 == 0]} the of") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, ("low", "high")[k % 2]) for k in range(60)], "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.posteriors(df, labels, ["high", "low"]).collect()}
    from pyspark.sql import functions as F

    fit = {r.doc_id for r in df.filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)) == 0).collect()}
    sets = {k: set(t.split()) for k, t in rows}
    counts = {d: Counter(w for k in fit for w in sets[k] if ("low", "high")[k % 2] == d) for d in ("high", "low")}
    size = {d: sum(("low", "high")[k % 2] == d for k in fit) for d in counts}
    all_ = {d: sum(c.values()) for d, c in counts.items()}
    raw = {k: {d: math.log(size[d] / len(fit)) + sum(math.log((counts[d][w] + 0.5) / (all_[d] + 0.5 * mixing.SLOTS)) for w in s) for d in counts} for k, s in sets.items()}
    odds = {k: math.log(r.p_high / r.p_low) / (raw[k]["high"] - raw[k]["low"]) for k, r in got.items() if min(r.p_high, r.p_low) > 1e-12}
    assert len(odds) > 3 and max(odds.values()) - min(odds.values()) < 1e-6  # one temperature for all


def test_op2_base_spans(spark, docs):
    for i, r in run(spark, "op2_pii").items():
        want = personal(docs[i]["text"])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone"))
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


def test_op3_held_out_languages(spark, docs):
    got = run(spark, "op3_language_id")
    assert all(r.held_out == (fold(i, 4) == 2) and 0 <= r.score <= 1 for i, r in got.items())
    asked = [i for i in docs if got[i].held_out and docs[i]["lang"] and len(docs[i]["text"] or "") > 100]
    assert len(asked) > 20 and sum(got[i].lang_pred == docs[i]["lang"] for i in asked) >= 0.95 * len(asked)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i]["text"] or "")) for i, r in got.items())


def test_op4_against_all_pairs(spark, docs):
    got, want = run(spark, "op4_minhash"), brute([(i, r["text"]) for i, r in docs.items()], 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(shingles(docs[i]["text"])) for i, r in got.items())


def test_op5_against_the_library(spark, docs):
    real = Tokenizer.from_file(vocabulary_path())
    for i, r in run(spark, "op5_bpe").items():
        ids = real.encode(docs[i]["text"] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(real.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op6_payloads(spark, docs):
    for i, r in run(spark, "op6_webp").items():
        raw = (docs[i]["text"] or "").encode()
        p = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_op7_base_and_held_out(spark, docs):
    got = run(spark, "op7_lm_scoring")
    c = Counter(w for i, r in docs.items() if fold(i, 7) != 2 for w in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        w = tokens(docs[i]["text"])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n * 1.0 + v + 1)) for x in w))
    long = [i for i in got if got[i].held_out and got[i].n_tokens > 50]
    size = sum(len(docs[i]["text"].encode()) + 1 for i in long)
    assert len(long) > 5 and sum(got[i].score for i in long) > size * math.log10(1 / 32)  # far better than chance among 64 classes


@pytest.mark.xfail(reason="open: on these tables the tree over bytes is behind the word counts, see the README", strict=True)
def test_op7_held_out_texts_against_the_word_counts(spark, docs):
    long = [r for i, r in run(spark, "op7_lm_scoring").items() if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in long) > sum(r.base_score for r in long)


def test_op10_held_out_labels(spark, docs):
    got = run(spark, "op10_toxicity")
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    assert set(got) == set(docs)


def test_words_that_a_polynomial_confuses(spark):
    """The Thue-Morse word and its complement collide under any polynomial modulo 2^64."""
    from volley.llm import minhash, suffix_tree

    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other)], "doc_id long, text string")
    assert [r.component_id for r in minhash.near_dedup(df).orderBy("doc_id").collect()] == [1, 2]
    assert {r.doc_id: r.n_known for r in suffix_tree.score_documents(df, df.doc_id == 1).collect()} == {1: 2, 2: 1}


def test_one_doc_id_with_two_texts(spark):
    from volley.llm import minhash

    rows = [(5, "one two three four five six"), (5, "a b c d e f g"), (1, "a b c d e f g"), (1, "A b c d e f g")]
    got = {(r.doc_id, r.key): r for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted((i, r.component_id, r.first) for (i, _), r in got.items()) == [(1, 1, False), (1, 1, True), (5, 1, False), (5, 5, True)]


def test_documents_of_the_mixture_meet_the_targets(spark):
    d = table(spark, SF, "documents").select("doc_id", "text")
    out = materialize(mixing.mix(d, domains_of(table(spark, SF, "labels")), mixing.TARGETS, least=1.0), "mixed").collect()
    assert len(out) == d.count() and min(r.copies for r in out) >= 1
