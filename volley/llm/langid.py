"""Language ID by bit-sliced Bloom filters over character n-grams.

Each of the m slots of the filter holds one bit a language; the AND of an n-gram's k slots is the set of languages
that contain it. A text's n-grams are looked up once for all languages, the bits are counted by language and corrected
for the filter's false positives; the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volley.llm.shared import give_back, materialize, mix64, small_batches, text_groups

SLOTS, HASHES = 1 << 20, 3
SAMPLE_DOCS = 3000
MIN_COUNT, MIN_SHARE = 4, 0.6
ORDERS = (2, 3, 4)
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """Per code point: its lower-case code point if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: list[np.ndarray] = []


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (letters lower-cased, others 0, a 0 before and after each text) and the n + 1 offsets of the texts,
    each from the 0 before it, so that a text's n-grams don't depend on its neighbours."""
    if not _table:
        _table.append(_letters())
    cps = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=off[1:])
    return _table[0][cps], off


def grams(letters: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, 64-bit hash) of the n-grams that start anywhere and don't span two words: a 0 may stand at the ends."""
    if len(letters) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(letters) - n + 1
    ok = np.ones(m, bool)
    for k in range(1, n - 1):
        ok &= letters[k : k + m] > 0
    ok &= (letters[:m] > 0) | (letters[n - 1 :] > 0) if n > 2 else (letters[:m] > 0) & (letters[1:] > 0)
    at = np.flatnonzero(ok)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + letters[at + k]
    return at, mix64(h)


def slots_of(h: np.ndarray, slots: int, k: int) -> np.ndarray:
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a + np.uint64(k) * b) % np.uint64(slots)


@dataclass
class LanguageModel:
    languages: list[str]
    masks: np.ndarray  # (words, slots): bit l of word l // 64
    false_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected counts (texts x languages), the number of n-grams and whether a text has letters."""
        letters, off = letters_of(texts)
        raw = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for n in ORDERS:
            at, h = grams(letters, n)
            row = np.searchsorted(off, at, "right") - 1
            total += np.bincount(row, minlength=len(texts))
            for w, mask in enumerate(self.masks):
                got = mask[slots_of(h, mask.size, 0)]
                for k in range(1, HASHES):
                    got &= mask[slots_of(h, mask.size, k)]
                for l in range(w * 64, min(len(self.languages), w * 64 + 64)):
                    raw[:, l] += np.bincount(row, (got >> np.uint64(l % 64)) & np.uint64(1), len(texts))
        rate = self.false_rate if len(self.false_rate) else np.zeros(len(self.languages))
        fixed = np.maximum(0, (raw - total[:, None] * rate) / np.maximum(1e-9, 1 - rate))
        has = np.zeros(len(texts), bool)
        has[np.searchsorted(off, np.flatnonzero(letters), "right") - 1] = True
        return fixed, total, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        fixed, _, has = self.counts([t or "" for t in texts])
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        best = fixed.argmax(1)
        share = fixed[np.arange(len(texts)), best] / np.maximum(fixed.sum(1), 1e-12)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has)], [float(min(1, s)) if h else 0.0 for s, h in zip(share, has)]


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE_DOCS, slots: int = SLOTS) -> LanguageModel:
    """A filter from the rows where `learn` holds and text and lang are not null.

    Of each language about `sample` rows are taken, by a hash of text (a documented bound of the labelled rows). An
    n-gram is put into a language's filter if it was seen MIN_COUNT times there and its frequency there is at least
    MIN_SHARE of its highest in any language. Repeated rows count as often as they occur, a text with two languages for
    both. Only filter slots, at most `slots` rows, reach the driver.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1, slots), np.uint64))
    number = {x: k for k, x in enumerate(languages)}
    keep = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, sample / sizes[x]))])
    rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < keep[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            off = np.cumsum([0, *(len(t) for t in texts)])
            for a, b in text_groups(off, 2_000_000):
                letters, places = letters_of(texts[a:b])
                lang = np.array([number[x] for x in langs[a:b]])
                for n in ORDERS:
                    at, h = grams(letters, n)
                    of = lang[np.searchsorted(places, at, "right") - 1]
                    for l in np.unique(of):
                        u, c = np.unique(h[of == l], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), l, np.int32)), pa.array(np.full(len(u), n, np.int32)), pa.array(c.astype(np.int64))], ["gram", "lang", "size", "n"])

    seen = materialize(rows.mapInArrow(count, "gram long, lang int, size int, n long").groupBy("gram", "lang", "size").agg(F.sum("n").alias("n")), "grams")
    totals = seen.groupBy("lang", "size").agg(F.sum("n").alias("all"))
    rated = seen.join(F.broadcast(totals), ["lang", "size"]).withColumn("p", F.col("n") / F.col("all"))
    best = rated.groupBy("gram").agg(F.max("p").alias("top"), F.collect_list(F.struct("lang", "n", "p")).alias("of"))  # one entry a language at most
    chosen = best.select("gram", F.explode(F.expr(f"filter(of, x -> x.n >= {MIN_COUNT} and x.p >= {MIN_SHARE} * top)")).alias("x")).select("gram", F.col("x.lang").alias("lang"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, lang = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))
            for k in range(HASHES):
                yield pa.RecordBatch.from_arrays([pa.array(slots_of(h, slots, k).astype(np.int64)), pa.array(lang // 64, pa.int32()), pa.array((np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64))], ["slot", "word", "mask"])

    bits = chosen.mapInArrow(fill, "slot long, word int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((-(-len(languages) // 64), slots), np.uint64)
    masks[bits["word"].to_numpy(), bits["slot"].to_numpy()] = bits["mask"].to_numpy().view(np.uint64)
    load = np.array([np.mean((masks[l // 64] >> np.uint64(l % 64)) & np.uint64(1)) for l in range(len(languages))])
    return LanguageModel(languages, masks, load**HASHES)


def detect(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score (columns of those names are replaced). Text that is null, empty or without
    letters is `und` with score 0; score is the share of the best language among the corrected counts. Of equally good
    languages the first by name is taken, so too (with score 0) if no n-gram of the text is known."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names, at = docs.columns, docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            off = np.cumsum([0, *(len(t or "") for t in texts)])
            langs, scores = [], []
            for a, b in text_groups(off, 1_000_000):
                got = sent.value.predict(texts[a:b])
                langs += got[0]
                scores += got[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])
            give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
