import hashlib

from pyspark.sql import functions as F

from volley.llm.exact_dedup import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_groups(spark):
    rows = [(1, "Same Text"), (7, "same text"), (3, "other"), (4, None), (5, ""), (6, "É"), (8, "é"), (9, "x" * 50000), (2, "X" * 50000), (None, "lone"), (None, "other"), (7, "same text")]
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, kept string")
    for weak in (None, lambda t: F.substring(t, 1, 1)):  # with a hash that collides, bytes decide
        got = exact_dedup(df, **({} if weak is None else {"hash_of": weak})).collect()
        assert len(got) == len(rows)
        for r in got:
            t = (r.text or "").translate(LOWER)
            same = [i for i, x in rows if (x or "").translate(LOWER) == t]
            ids = [i for i in same if i is not None]
            assert r.group_size == len(same) and r.keep_id == (max(ids) if ids else None)
            assert r.kept == (r.doc_id == r.keep_id) and r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert {r.keep_id for r in exact_dedup(df, keep="min").collect() if (r.text or "").lower() == "same text"} == {1}
    assert exact_dedup(df.limit(0)).collect() == []
