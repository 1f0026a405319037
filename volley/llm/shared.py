"""What several operators use: scratch tables, size-checked broadcasts, hold-outs, text buffers."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows up to which a side is broadcast; beyond, the join shuffles both sides.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is named (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="volley-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with right, broadcast if it has at most `limit` rows by count (right must be cheap to count: a
    materialized table), otherwise as a shuffled join that Spark may split where keys are skewed."""
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def join_hot(left: DataFrame, right: DataFrame, on: str, share: int = 500) -> DataFrame:
    """Inner join of left (a written table) with right (one row a key). Keys with more than a `share`-th of left's rows,
    of which there are fewer than `share`, are joined by broadcast, the others by hash: no task gets a hot key."""
    n = left.count()
    hot = left.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(1000, n // share)).select(on)
    hot = materialize(right.join(F.broadcast(hot), on, "left_semi"), "hot")
    if hot.isEmpty():
        return left.join(right.hint("merge"), on)
    cold = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.hint("merge"), on)
    return left.join(F.broadcast(hot), on).select(*cold.columns).unionByName(cold)


def give_back() -> None:
    """Returns memory that Arrow's pool holds but doesn't use: called by workers between groups of texts, so that each
    holds what its group needs and not what its largest one needed."""
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most about `size`: a batch of 10,000 rows of long texts would fill a worker's memory. A
    size that the application was started with stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is None:
        spark.conf.set(name, size)


def top_counts(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of counts (a written table) whose count `n` is at least t, for the least t that at most `most` rows
    reach. No row is sorted or sent anywhere: t comes from an aggregate over some hundreds of count classes."""
    c = F.col(n)
    step = F.pow(F.lit(2), F.greatest(F.floor(F.log2(c)) - 6, F.lit(0)))
    low = (F.floor(c / step) * step).cast("long")  # exact below 128, then 64 classes an octave
    least, seen = None, 0
    for r in sorted(counts.groupBy(low.alias("low")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r.low):
        seen += r.m
        if seen > most:
            break
        least = r.low
    return counts.filter(c >= least) if least is not None else counts.filter(F.lit(False))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many _ before them as keep them apart from the columns of df (whatever their case)."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}" in there:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: Fixed table for numpy: byte -> byte with A-Z lower-cased.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column on end, and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_groups(offsets: np.ndarray, most: int = 4_000_000):
    """Ranges (a, b) of rows whose texts have at most `most` bytes in all, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one; the others eight bytes of all words at a time.
_LONG = 256
#: Fixed table: what of eight bytes belongs to a word of which n are left.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every word: maximal runs without ASCII white space, A-Z lower-cased, in order.

    Each eight bytes are mixed into the hash by a function that isn't linear in them, so no family of different words
    collides whatever the constants (a polynomial modulo 2^64 has such families).
    """
    low = LOWER_BYTES[raw]
    letter = ~IS_SPACE[low]
    starts_text = np.zeros(len(low) + 1, bool)
    starts_text[offsets] = True
    before = np.empty(len(low), bool)
    before[:1] = False
    before[1:] = letter[:-1]
    first = letter & (~before | starts_text[:-1])
    after = np.empty(len(low), bool)
    after[-1:] = False
    after[:-1] = letter[1:]
    last = letter & (~after | starts_text[1:])
    start, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= start
    h = mix64(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    eight = np.ndarray(len(low) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    live = np.flatnonzero(size <= _LONG)
    for k in np.flatnonzero(size > _LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(low[start[k] : start[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
    at = 0
    while len(live):
        left = size[live] - at
        block = eight[start[live] + at] & _LEFT[np.minimum(left, 8)]
        h[live] = mix64(mix64(h[live] + np.uint64(0x9E3779B97F4A7C15)) ^ block)
        live, at = live[left > 8], at + 8
    return np.searchsorted(offsets, start, "right") - 1, h
