"""Each stage on a small corpus against a brute-force version of what it decides."""

import re

import numpy as np
from tests.llm.test_minhash import brute, made
from tokenizers import Tokenizer

import corpus_pipeline
from volley.llm.queries import vocabulary_path


def test_stages(spark, tmp_path):
    g = np.random.default_rng(5)
    stems = {"en": "the of and ing tion er st", "de": "und der sch ein lich ung keit"}
    rows = []
    for k, (i, t) in enumerate({i: (i, t) for i, t in made(9, 90)}.values()):
        lang = "en" if k % 2 else "de"
        text = t + " " + " ".join("".join(g.choice(stems[lang].split(), 2)) for _ in range(30)) if k % 3 else t
        rows.append((i, text, lang, f"s{k % 3}", len(text)))
    rows += [(10**7 + 1, rows[0][1], "de", "s0", 1), (10**7 + 2, rows[4][1].upper(), "de", "s0", 1), (10**7 + 3, None, "en", "s0", 0), (10**7 + 4, "", None, "s0", 0), (10**7 + 5, "123 !!", "en", "s0", 0)]
    rows += [rows[7]]  # a repeated row
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], k % 2, int(k % 5 == 0)) for k, r in enumerate(rows) if k % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept, step = docs.columns, {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, d).write.parquet(f"{d}/{k}")
        step = spark.read.parquet(f"{d}/{k}")
        kept[name] = step.collect()
        if name != "encode":
            assert step.columns == columns
    words = [r for r in rows if re.search(r"[^\W\d_]{2}", r[1] or "")]  # two letters on end: n-grams that many texts have
    assert sorted(r.doc_id for r in kept["language"]) == sorted(r[0] for r in words)
    groups = {}
    for r in words:
        groups.setdefault(r[1].lower(), []).append(r[0])
    assert sorted(r.doc_id for r in kept["exact"]) == sorted(max(v) for v in groups.values())
    roots = brute([(r.doc_id, r.text) for r in kept["exact"]], 80)
    assert sorted(r.doc_id for r in kept["near"]) == sorted(set(roots.values()))
    assert {r.doc_id for r in kept["mix"]} == {r.doc_id for r in kept["near"]} and len(kept["mix"]) >= len(kept["near"])
    real = Tokenizer.from_file(vocabulary_path())
    text = {r.doc_id: r.text for r in kept["mix"]}
    assert len(kept["encode"]) == len(kept["mix"])
    assert all(r.ids == real.encode(text[r.doc_id], add_special_tokens=False).ids for r in kept["encode"])


def test_near_keeps_another_text_of_a_dropped_doc_id(spark):
    rows = [(5, "one two three four five six"), (5, "a b c d e f g"), (1, "a b c d e f g")]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept)) == [(1, "a b c d e f g"), (5, "one two three four five six")]
