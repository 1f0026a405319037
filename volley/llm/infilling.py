"""Fill-in-middle: texts are cut at two token boundaries and put together with the middle last.

The offsets of all boundaries of a text are kept as a learned rank index: straight pieces that predict the offset of the
k-th boundary within a bound, and a byte for what the prediction is off. A stored index gives the cuts of any seed without
cutting tokens again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volley.llm.shared import IS_SPACE, small_batches, text_buffer, text_groups, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are cut, and of these that have the suffix first; the seed.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
#: A prediction is off by at most BOUND before it is rounded; slopes are whole numbers of 2^-SHIFT.
BOUND, SHIFT = 120, 20
#: Boundaries that a straight piece is first tried on; the stretch doubles while the piece holds.
STRETCH = 256
PIECES = T.ArrayType(T.StructType([T.StructField("rank", T.LongType()), T.StructField("at", T.LongType()), T.StructField("slope", T.LongType())]))


def boundaries(raw: np.ndarray) -> np.ndarray:
    """Offsets in code points at which the tokens of a text start, and its length: a token is white space and the word
    behind it, or the white space at the end."""
    if not len(raw):
        return np.zeros(1, np.int64)
    space = IS_SPACE[raw]
    first = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each code point
    space = space[first]
    after_word = ~space[:-1] & space[1:]
    return np.concatenate([[0], np.flatnonzero(after_word) + 1, [len(first)]])


def fit(at: np.ndarray, bound: int = BOUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, offset, slope) of pieces that start at a boundary and stay within `bound` of all offsets: each is as long
    as one slope fits, slopes narrowing from boundary to boundary."""
    ranks, slopes, a, n = [], [], 0, len(at)
    while a < n:
        end, low, high, slope, stretch = a + 1, -np.inf, np.inf, 0.0, STRETCH
        while end < n:
            k = np.arange(end, min(n, end + stretch))
            rise, run = at[k] - at[a], (k - a).astype(float)
            lows = np.maximum(np.maximum.accumulate((rise - bound) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + bound) / run), high)
            bad = np.flatnonzero(lows > highs)
            last = int(bad[0]) if len(bad) else len(k)
            if last:
                low, high = lows[last - 1], highs[last - 1]
                slope = (low + high) / 2
            end += last
            if len(bad):
                break
            stretch *= 2
        ranks.append(a)
        slopes.append(round(slope * (1 << SHIFT)))
        a = end
    ranks = np.array(ranks, np.int64)
    return ranks, at[ranks], np.array(slopes, np.int64)


def predict(rank: np.ndarray, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    ranks, at, slope = pieces
    k = np.searchsorted(ranks, rank, "right") - 1
    return at[k] + (slope[k] * (rank - ranks[k]) >> SHIFT)


def index_texts(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """docs with n (tokens), pieces and residuals added (columns of those names are replaced): the offset of boundary k,
    0 to n, is that predicted by its piece plus byte k of residuals less 128. Null texts count as empty: n is 0 and
    boundary 0 is at 0."""
    small_batches(docs.sparkSession)
    docs = docs.drop("n", "pieces", "residuals")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(at))
            for a, b in text_groups(off):
                n, sizes, parts, rest = [], [0], [], []
                for x, y in zip(off[a:b].tolist(), off[a + 1 : b + 1].tolist()):
                    cuts = boundaries(raw[x:y])
                    pieces = fit(cuts, bound)
                    off_by = cuts - predict(np.arange(len(cuts)), pieces)
                    assert abs(off_by).max() < 128
                    n.append(len(cuts) - 1)
                    sizes.append(len(pieces[0]))
                    parts.append(pieces)
                    rest.append((off_by + 128).astype(np.uint8).tobytes())
                fields = [pa.array(np.concatenate([p[k] for p in parts])) for k in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(fields, ["rank", "at", "slope"]))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(n, pa.int64()), lists, pa.array(rest, pa.binary())], [*names, "n", "pieces", "residuals"])

    added = [T.StructField("n", T.LongType()), T.StructField("pieces", PIECES), T.StructField("residuals", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def offset_of(rank: Column, pieces: str = "pieces", residuals: str = "residuals") -> Column:
    """The offset of boundary `rank`: predicted by the last piece that starts at or before it, then corrected."""
    piece = F.element_at(F.filter(pieces, lambda p: p["rank"] <= rank), -1)
    residual = F.conv(F.hex(F.substring(residuals, (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long") - 128
    return piece["at"] + F.shiftright(piece["slope"] * (rank - piece["rank"]), SHIFT) + residual


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the id (a null id counts as the empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, with_text: bool = False) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output added (columns of those names, and of the index's, are
    replaced). docs may come from index_texts, or a table written from it; otherwise the index is made here.

    form is plain (output is the text) for texts that are empty, null or contain a marker, and for those whose draw is
    beyond `rate` percent; spm puts the suffix before the prefix, psm the prefix before the suffix, the middle is last.
    Lengths are code points, null if plain. The draws depend on doc_id alone: rows of one doc_id are cut by the same
    draws, whatever their text. Nothing is shuffled.
    """
    there = {"n", "pieces", "residuals"} <= set(docs.columns)
    docs = docs if there else index_texts(docs)
    docs = docs.drop("form", "prefix_chars", "middle_chars", "output")
    own = [c for c in docs.columns if c not in ("n", "pieces", "residuals") and (with_text or c != "text")]
    h1, h2, h3, h4, a, b, t = unused(docs, "h1", "h2", "h3", "h4", "a", "b", "t")
    out = docs.withColumns(dict(zip([h1, h2, h3, h4], draws(F.col("doc_id"), seed))) | {t: F.coalesce("text", F.lit(""))})
    one, two = F.col(h1) % (F.col("n") + 1), F.col(h2) % (F.col("n") + 1)
    marked = F.contains(F.col(t), F.lit(PREFIX)) | F.contains(F.col(t), F.lit(SUFFIX)) | F.contains(F.col(t), F.lit(MIDDLE))
    plain = (F.col(t) == "") | marked | (F.col(h3) % 100 >= rate)
    out = out.withColumn("form", F.when(plain, "plain").when(F.col(h4) % 100 < suffix_first, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    out = out.withColumns({a: F.when(cut, offset_of(F.least(one, two))), b: F.when(cut, offset_of(F.greatest(one, two)))})
    text, first, last = F.col(t), F.col(a).cast("int"), F.col(b).cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, last - first), F.substring(text, last + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    return out.select(*own, "n", "form", F.col(a).alias("prefix_chars"), (F.col(b) - F.col(a)).alias("middle_chars"), made.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The exact text, from output and form: a cut text contains no marker, so each marker of the output is where it was
    put, the outer ones first."""
    head, tail = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    body = F.substring(head, F.lit(4), F.length(head))
    psm = F.concat(F.substring_index(body, SUFFIX, 1), tail, F.substring_index(body, SUFFIX, -1))
    spm = F.concat(F.substring_index(body, PREFIX, -1), tail, F.substring_index(body, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(made: DataFrame) -> DataFrame:
    """doc_id, counts and form with the digests of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
