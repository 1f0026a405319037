"""From raw documents to token ids: language, exact copies, near copies, mixture, encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volley.llm import bpe, exact_dedup, langid, minhash, mixing
from volley.llm.queries import domains_of, vocabulary_path
from volley.llm.shared import ascii_lower, fold, join_small, materialize, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language is undetermined: null, empty or without letters, and those of whose n-grams no language
    knows one (all of them if none was learned)."""
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    found = langid.detect(docs, model)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") > 0)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays; of its repeats, one."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(*docs.columns)
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    (text,) = unused(docs, "text")
    return kept.withColumn(text, F.md5(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"))).dropDuplicates(["doc_id", text]).drop(text)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8 or more) the row with the smallest doc_id stays (of
    rows of one doc_id, one text). Rows are told apart by doc_id and text, so another text of a dropped doc_id stays."""
    gone = minhash.near_dedup(docs.select("doc_id", "text"), percent=80).filter("not first").select("doc_id", "key").distinct()
    (key,) = unused(docs, "key")
    rows = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return join_small(rows, materialize(gone.withColumnRenamed("key", key), "dropped"), ["doc_id", key], "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their rates (at least 1: none is lost) so that the domains' shares of tokens meet the targets.
    Null or empty texts have no tokens and stay once; rows of one doc_id and text share a rate, each being repeated."""
    mixed = mixing.mix(docs.select("doc_id", "text"), domains_of(table(spark, sf_dir, "labels")), mixing.TARGETS, least=1.0)
    return mixing.apply_copies(docs, mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with the digests of ids and decoded text; null texts have none, repeated rows a row
    each."""
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), vocabulary_path(), with_text=False).drop("text")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: The classifiers, the sketches and the tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
