"""MinHash near-dedup: one-permutation sketches, banded buckets, star-shaped candidates, exact confirmation.

A text's set is its distinct 5-word shingles (as 64-bit hashes). One permutation gives K bins; empty bins are filled by
optimal densification (each tries bins in its own pseudo-random order until one has a value). Bands of the bins are
buckets. In a bucket only edges to a centre are candidates, so a bucket of m sets gives m - 1 of them; each is
confirmed on the full sets. In a bucket that then holds several components, the sets outside its largest one become
centres, CENTRES at most in a round, until all of them have been: every pair across components has such an end, so no
link inside a bucket is lost, and no bucket is ever expanded into all its pairs. There a bound from BITS flags of each
set, which no linked pair exceeds, is tested within the join, before full sets are fetched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volley.llm.shared import join_hot, join_small, materialize, mix64, small_batches, text_buffer, text_groups, word_hashes

WORDS = 5
BANDS, ROWS = 48, 8
CENTRES, BITS = 4096, 768


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, on end; and the n + 1 offsets of the texts' parts.

    Words are runs without ASCII white space, A-Z lower-cased. A text of 1 to k - 1 words has one shingle, all of it.
    """
    row, h = word_hashes(raw, offsets)
    n = len(offsets) - 1
    words = np.bincount(row, minlength=n)
    first = np.cumsum(words) - words
    mult = [np.uint64(pow(0x9E3779B97F4A7C15, e, 1 << 64) | 1) for e in range(1, k + 1)]
    if len(h) >= k:
        m = len(h) - k + 1
        s = np.zeros(m, np.uint64)
        for j in range(k):
            s += mix64(h[j : j + m] * mult[j])
        s = mix64(s)
    else:
        s = np.zeros(0, np.uint64)
    parts = []
    for a, c in zip(first.tolist(), words.tolist()):
        if c >= k:
            parts.append(np.unique(s[a : a + c - k + 1]))
        elif c:
            x = np.array([c], np.uint64)
            for j in range(c):
                x = mix64(x * mult[0] + h[a + j])
            parts.append(x)
        else:
            parts.append(np.zeros(0, np.uint64))
    at = np.zeros(n + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), at


def signatures(sets: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of each set, densified; sets without shingles get zeros."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    key = row * bins + ((sets >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1) != 0)  # ascending in a set, so the first of a bin is its smallest
    out, full = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    out[key[first]], full[key[first]] = sets[first], True
    out, full = out.reshape(n, bins), full.reshape(n, bins)
    r, b = np.nonzero(~full & (np.diff(at) > 0)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        j = (mix64(b.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = full[r, j]
        out[r[hit], b[hit]] = out[r[hit], j[hit]]
        r, b = r[~hit], b[~hit]
    return out


def bucket_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for j in range(rows):
        keys = mix64(keys * np.uint64(0xD6E8FEB86659FD93) + sig[:, j::rows][:, :bands])
    return keys


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = WORDS) -> DataFrame:
    """(doc_id, key, n_shingles, node, buckets): node is a 128-bit digest of the set; null for no set or no doc_id. key is
    xxhash64 of the text (null as empty): with doc_id it tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for a, b in text_groups(off):
                sets, at = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], k)
                keys = bucket_keys(signatures(sets, at, bands * rows), bands, rows)
                data, p = sets.view(np.uint8), at * 8
                valid = batch.column(0).slice(a, b - a).is_valid().to_numpy(zero_copy_only=False)
                node = [hashlib.blake2b(data[x:y], digest_size=16).digest() if y > x and v else None for x, y, v in zip(p[:-1].tolist(), p[1:].tolist(), valid)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(at)), pa.array(node, pa.binary()), lists], ["doc_id", "key", "n_shingles", "node", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).mapInArrow(run, f"doc_id {kind}, key long, n_shingles long, node binary, buckets array<long>")


def full_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(node, shingles, bits) of each text; bits: BITS flags, number h modulo BITS is set for each hash h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            for a, b in text_groups(off):
                sets, at = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], k)
                node = [hashlib.blake2b(sets[x:y].view(np.uint8), digest_size=16).digest() for x, y in zip(at[:-1], at[1:])]
                flags = np.zeros((b - a, BITS), bool)
                flags[np.repeat(np.arange(b - a), np.diff(at)), (sets % np.uint64(BITS)).astype(np.int64)] = True
                words = np.packbits(flags, axis=1).view(np.int64)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * (BITS // 64)), pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64))), bits], ["node", "shingles", "bits"])

    return docs.select("text").mapInArrow(run, "node binary, shingles array<long>, bits array<long>")


def components(edges: DataFrame, name: str = "comp") -> DataFrame:
    """(node, comp) of the nodes of edges (a, b): comp is the smallest node that is reachable.

    Labels spread along the edges and are then replaced by their own label (pointer jumping), until none changes;
    each round is written to the shared folder. The nodes with many edges (the centres of stars) and the labels of many
    nodes are joined by broadcast, so none of them is the key of a task.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), name)
    while True:
        near = join_hot(both, labels.withColumnsRenamed({"node": "b", "comp": "of"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("of").alias("of"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "of").alias("next"))
        up = step.select(F.col("node").alias("next"), F.col("next").alias("top"))
        step = materialize(join_hot(materialize(step, name), up, "next").select("node", "was", F.least("next", "top").alias("comp")), name)
        labels = step.select("node", "comp")
        if step.filter("comp <> was").isEmpty():
            return labels


def near_dedup(docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS, k: int = WORDS) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept, key, first.

    Texts whose sets have 100 * intersection >= percent * union are linked; component_id is the smallest doc_id
    reachable, kept tells whether it is the row's own. Null or empty text has no set and is linked with nothing; a
    null doc_id is linked with nothing, has a null component_id and is kept. Rows of equal sets are one node, so
    copies cost one row each. Repeated rows of the kept doc_id are all kept. key is xxhash64 of the text; first is true
    for the rows of one (doc_id, key), the smallest, of each component: where doc_ids repeat with different texts, the
    representative. Sets are compared by 64-bit hashes of their shingles.
    """
    small_batches(docs.sparkSession)
    rows_ = materialize(sketch(docs, bands, rows, k), "sketch")
    own = F.min(F.struct("doc_id", "key"))
    nodes = rows_.filter("node is not null").groupBy("node").agg(own["doc_id"].alias("doc_id"), own["key"].alias("key"), F.any_value("n_shingles").alias("n"), F.any_value("buckets").alias("buckets"))
    nodes = materialize(nodes, "nodes")
    spread = nodes.select("node", "n", "doc_id", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    members = materialize(spread.join(shared.hint("merge"), "bucket"), "members")  # of buckets with two sets or more
    wanted = materialize(members.select("doc_id").distinct(), "wanted")
    texts = join_small(docs.select("doc_id", "text"), wanted, "doc_id", "left_semi")
    sets = materialize(full_sets(texts, k).dropDuplicates(["node"]), "sets")
    # a set that shares large buckets is near many others (the original of many copies): it is the better centre
    density = members.groupBy("node").agg(F.sum("m").alias("dense"))
    members = materialize(members.select("bucket", "node", "n").join(density.hint("merge"), "node"), "members")

    def confirm(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a")
        inter = F.size(F.array_intersect("sa", "sb")).cast("long")
        return both.select("a", "b", (inter * 100 >= (F.size("sa") + F.size("sb") - inter) * percent).alias("linked"))

    def fits(x: str, y: str) -> F.Column:
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    best = members.groupBy("bucket").agg(F.max(F.struct("dense", "node", "n")).alias("c"))
    def may_link() -> F.Column:
        """Exact bound: each flag of one set only is an element of that set only, so the sets share at most n - flags."""
        both = sum((F.bit_count(F.col(f"fa{k}").bitwiseAND(F.col(f"fb{k}"))) for k in range(1, BITS // 64)), F.bit_count(F.col("fa0").bitwiseAND(F.col("fb0"))))
        most = F.least(F.col("na") - F.col("fa") + both, F.col("nb") - F.col("fb") + both)
        return most * 100 >= (F.col("na") + F.col("nb") - most) * percent

    def flags(end: str) -> DataFrame:
        one = [F.get("bits", F.lit(k)) for k in range(BITS // 64)]
        return sets.select(F.col("node").alias(end), sum(map(F.bit_count, one[1:]), F.bit_count(one[0])).alias(f"f{end}"), *[x.alias(f"f{end}{k}") for k, x in enumerate(one)])

    start = members.join(best.hint("merge"), "bucket").filter(F.col("node") != F.col("c.node")).groupBy("node", "n").agg(F.max("c").alias("c"))
    start = start.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("c.node").alias("a"), F.col("c.n").alias("na")).filter(fits("na", "nb"))
    tested = materialize(confirm(start.select("a", "b")), "tested")
    comp, used = components(tested.filter("linked").select("a", "b")), None
    while True:
        # any pair across components has an end outside the bucket's largest component: those ends become centres
        live = materialize(members.join(comp.hint("merge"), "node", "left").select("bucket", "node", "n", "dense", F.coalesce("comp", "node").alias("comp")), "live")
        parts = live.groupBy("bucket", "comp").agg(F.count("*").alias("s")).groupBy("bucket").agg(F.max(F.struct("s", "comp"))["comp"].alias("big"), F.count("*").alias("parts"), (F.sum("s") - F.max("s")).alias("few"))
        live = materialize(live.join(parts.filter("parts > 1").drop("parts").hint("merge"), "bucket"), "live")
        small = live.filter("comp <> big")
        if used is not None:
            small = small.join(used.hint("merge"), ["bucket", "node"], "left_anti")
        part = F.when(F.col("few") <= CENTRES, F.hex("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(CENTRES)).cast("string"))
        chosen = small.groupBy("bucket", part.alias("part")).agg(F.max(F.struct("dense", "node", "n", "comp")).alias("c"))
        chosen = materialize(chosen.select("bucket", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.comp").alias("ca")), "chosen")
        if chosen.isEmpty():
            break
        one = chosen.join(flags("a").hint("merge"), "a")
        two = live.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb")).join(flags("b").hint("merge"), "b")
        pairs = two.join(one.hint("merge"), (two["bucket"] == one["bucket"]) & (F.col("ca") != F.col("cb")) & fits("na", "nb") & may_link())
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct()
        pairs = materialize(pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).hint("merge"), ["a", "b"], "left_anti"), "pairs")
        new = materialize(confirm(pairs.select("a", "b")), "tested")
        now = chosen.select("bucket", F.col("a").alias("node"))
        used = now if used is None else used.union(now)
        tested = tested.union(new)
        links = materialize(pairs.join(new.filter("linked").hint("merge"), ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")
        if not links.isEmpty():  # the components that meet become one
            joined = components(links).withColumnsRenamed({"node": "old", "comp": "new"})
            whole = members.select("node").distinct().join(comp.hint("merge"), "node", "left").select("node", F.coalesce("comp", "node").alias("old"))
            comp = materialize(whole.join(joined.hint("merge"), "old", "left").select("node", F.coalesce("new", "old").alias("comp")), "comp")
    classes = nodes.select("node", "doc_id", "key").join(comp.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = classes.groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    classes = materialize(join_hot(materialize(classes.select("node", "comp"), "classes"), least, "comp").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("_key")), "classes")
    out = join_small(rows_.select("doc_id", "n_shingles", "node", "key"), classes, "node", "left")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id")).withColumn("kept", kept)
    return out.select("doc_id", "n_shingles", "component_id", "kept", "key", (F.col("kept") & F.coalesce(F.col("key") == F.col("_key"), F.lit(True))).alias("first"))
