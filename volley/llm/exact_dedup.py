"""Exact dedup: a 128-bit content hash groups the texts, bytes are compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volley.llm.shared import ascii_lower, join_small, materialize, unused


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def exact_dedup(docs: DataFrame, keep: str = "max", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 added (columns of those names are replaced).

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty. Of equal texts the largest
    (keep="max") or smallest (keep="min") doc_id stays. Repeated rows of the doc_id that stays are all kept; a null
    doc_id never stays if the group has another one, and is its own keep_id (null, kept) if it has none.

    Only (hash, id) rows are shuffled for grouping. Texts move only for hashes that occur twice or more, and there
    they are grouped by (hash, text) with partial sums, so that a hot group shrinks to one row a task; grouping by
    the text is the byte comparison. A hash with two texts (a collision) is told apart by a join on the text.
    """
    best = F.max if keep == "max" else F.min
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    n, h, k, g = unused(docs, "n", "h", "k", "g")
    docs = docs.withColumn(n, ascii_lower(F.coalesce("text", F.lit("")))).withColumn(h, hash_of(F.col(n)))
    twice = materialize(docs.groupBy(h).agg(F.count("*").alias("n")).filter("n > 1").select(h), "twice")
    members = join_small(docs.select("doc_id", h, n), twice, h, "left_semi")
    classes = materialize(members.groupBy(h, n).agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "classes")
    collided = materialize(classes.groupBy(h).agg(F.count("*").alias("c")).filter("c > 1").select(h), "collided")
    plain = classes.join(collided, h, "left_anti") if not collided.isEmpty() else classes
    out = join_small(docs, plain.drop(n), h, "left")
    if not collided.isEmpty():
        apart = classes.join(collided, h, "left_semi").select(h, n, F.col("keep_id").alias(k), F.col("group_size").alias(g))
        out = out.join(apart, [h, n], "left").withColumns({"keep_id": F.coalesce("keep_id", k), "group_size": F.coalesce("group_size", g)}).drop(k, g)
    return (
        out.withColumns({"keep_id": F.coalesce("keep_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1).cast("long")), "text_sha256": F.sha2(F.col(n).cast("binary"), 256)})
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .drop(h, n)
    )
