from pyspark.sql import functions as F

from volley.llm import langid

SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and then some more words of it", "fr": "le renard brun saute par dessus le chien paresseux et encore des mots à lire", "de": "der schnelle braune fuchs springt über den faulen hund und noch mehr wörter"}


def test_detect(spark):
    rows = [(i, SAMPLES[x] + f" {x}" * (i % 3), x) for i in range(90) for x in SAMPLES] + [(900, "zzz", None), (901, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True))
    assert model.languages == ["de", "en", "fr"]
    probe = spark.createDataFrame([(1, "the lazy dog", 0), (2, "le chien paresseux", 0), (3, "ÜBER DEN HUND", 0), (4, None, 0), (5, "", 0), (6, "123 !!", 0), (6, "123 !!", 0), (None, "the fox" * 5000, 0)], "doc_id long, text string, score int")
    got = [(r.doc_id, r.lang_pred) for r in langid.detect(probe, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "fr"), (3, "de"), (4, "und"), (5, "und"), (6, "und"), (6, "und"), (None, "en")], key=str)
    assert all(0 <= r.score <= 1 for r in langid.detect(probe, model).collect())
    assert langid.detect(probe.limit(0), model).collect() == []
    assert [r.lang_pred for r in langid.detect(probe, langid.train(df.limit(0), F.lit(True))).collect()] == ["und"] * 8


def test_filter_finds_every_gram_put_in(spark):
    df = spark.createDataFrame([(i, SAMPLES["en"], "en") for i in range(10)], "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True))
    fixed, total, has = model.counts([SAMPLES["en"], "qqqq xkxk"])
    assert has.all() and fixed[0, 0] > 0.99 * total[0] and fixed[1, 0] < 0.2 * total[1]


def test_letters_of_every_plane_count(spark):
    """A text of CJK extension G has letters, though no language is known for them."""
    df = spark.createDataFrame([(i, SAMPLES["en"], "en") for i in range(10)], "doc_id long, text string, lang string")
    got = langid.detect(spark.createDataFrame([(1, "\U00030001\U00030002")], "doc_id long, text string"), langid.train(df, F.lit(True))).first()
    assert got.lang_pred != "und" and got.score == 0
