"""Toxicity: a support vector machine on a gapped subsequence string kernel with Nystroem landmarks.

The instances are stretches of labelled sentences. The kernel of two stretches is the normalised dot product of their
weighted triples of symbols, each neighbour of a triple at most one symbol away from being adjacent, so one inserted
letter between any two keeps most triples; triples run on from word to word within a sentence. Letters are taken without
marks and digits between them, and single letters with spaces between them are one word. Only whole texts are labelled:
the machine is first fitted on stretches drawn from all of them, then, in rounds, on each text's highest stretch, toxic
or not, beside drawn ones (multiple-instance learning). It is linear in the landmarks' kernel values, hence linear in
the triples, and is folded into one table of weights for scoring. A logistic map of a text's stretch decisions, fitted
on labelled texts, gives the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volley.llm.shared import join_small, materialize, small_batches, text_groups

EDGE, SPACE = 63, 64
DECAY = 0.5
LANDMARKS = 192
#: Documented bounds of the labelled sample: texts of each class, stretches drawn from each text.
SAMPLE_DOCS, DRAWN = 4000, 3
#: Words of a stretch, at most (longer ones found no more on held-out labels and flagged more clean texts); rounds of
#: fitting on the highest stretches.
SCALES, ROUNDS = (1, 2), 3
FEATURES = 5

_table: list[np.ndarray] = []


def symbols(cps: np.ndarray) -> np.ndarray:
    """a-z: 1 to 26, other letters: 27 to 62 by code point, white space: SPACE, all else: 0."""
    if not _table:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()[0]
                out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 40503 // 64 % 36
            elif s.isspace():
                out[c] = SPACE
        _table.append(out)
    return _table[0][cps]


@dataclass
class Words:
    """The words of texts: their symbols on end with an EDGE before and after each; by word its first symbol's place, its
    text, its sentence (numbered over all texts), and the places of its first and last letter in its text."""

    symbols: np.ndarray
    start: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    first: np.ndarray
    last: np.ndarray


def words_of(texts: list[str]) -> Words:
    """A sentence ends with the line, or with . ! or ? before white space."""
    cps = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    s = symbols(cps)
    at = np.cumsum([len(t) + 1 for t in texts])
    keep = np.flatnonzero((s > 0) & (s < SPACE))
    none = np.zeros(0, np.int64)
    if not len(keep):
        return Words(np.zeros(0, np.uint8), *[none] * 5)
    row = np.searchsorted(at, keep, "right")
    ends = np.zeros(len(s), bool)
    ends[1:] = (s[1:] == SPACE) & np.isin(cps[:-1], [33, 46, 63])
    ends |= cps == 10
    gaps, sentence = np.cumsum(s == SPACE)[keep], np.cumsum(ends)[keep]
    new = np.diff(gaps, prepend=-1) > 0
    new[0] = True
    word = np.cumsum(new) - 1
    single = np.bincount(word) == 1
    other = np.diff(sentence, prepend=-1) > 0
    joined = new & ~other  # a single letter after a single letter goes on with its word
    joined[1:] &= single[word[1:]] & single[word[:-1]]
    joined[0] = False
    word = np.cumsum(new & ~joined) - 1
    first = np.flatnonzero(np.diff(word, prepend=-1))
    size = np.diff(first, append=len(word))
    out = np.full(len(keep) + 2 * len(first), EDGE, np.uint8)
    out[np.arange(len(keep)) + 2 * word + 1] = s[keep]
    begin = np.concatenate([[0], at[:-1]])[row]
    return Words(out, first + 2 * np.arange(len(first)), row[first], sentence[first], (keep - begin)[first], (keep - begin)[first + size - 1])


def triples(w: Words) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(place, feature, weight) for each of the four spacings; a triple lies in one sentence."""
    part = np.repeat(w.sentence, np.diff(w.start, append=len(w.symbols)))
    s, out = w.symbols.astype(np.int32), []
    for a, b in ((1, 1), (2, 1), (1, 2), (2, 2)):
        m = len(s) - a - b
        if m <= 0:
            continue
        at = np.flatnonzero(part[:m] == part[a + b :])
        out.append((at, s[at] << 12 | s[at + a] << 6 | s[at + a + b], DECAY ** (a + b - 2)))
    return out


def vectors(stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse normalised kernel features of stretches: (stretch, feature, value), by stretch."""
    w = words_of([x.replace("\n", " ") for x in stretches])
    of = np.repeat(w.text, np.diff(w.start, append=len(w.symbols)))
    parts = [(of[at], f, np.full(len(at), x)) for at, f, x in triples(w)] or [(np.zeros(0, int),) * 2 + (np.zeros(0),)]
    i, f, v = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(i, kind="stable")
    i, f, v = i[order], f[order], v[order]
    norm = np.sqrt(np.bincount(i, v * v, len(stretches)))
    return i, f, v / np.maximum(norm[i], 1e-9)


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    i, f, v = vectors(b)
    used = np.unique(f)
    table = np.zeros((len(used) + 1, len(b)), np.float32)  # the last row is that of all other features
    np.add.at(table, (np.searchsorted(used, f), i), v)
    out = np.zeros((len(a), len(b)))
    for lo in range(0, len(a), 500):
        i, f, v = vectors(a[lo : lo + 500])
        at = np.minimum(np.searchsorted(used, f), max(len(used) - 1, 0))
        hit = used[at] == f if len(used) else np.zeros(len(f), bool)
        i, at, v = i[hit], at[hit], v[hit]
        if len(i):
            first = np.flatnonzero(np.diff(i, prepend=-1))
            out[lo + i[first]] = np.add.reduceat(v[:, None].astype(np.float32) * table[at], first, axis=0)
    return out


def _newton(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """The squared-hinge support vector machine: Newton steps on the rows inside the margin."""
    w = np.zeros(z.shape[1])
    for _ in range(30):
        sv = y * (z @ w) < 1
        new = np.linalg.solve((z[sv] * weight[sv, None]).T @ z[sv] + ridge * weight.sum() * np.eye(len(w)), (z[sv] * weight[sv, None]).T @ y[sv])
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * w + 0.5 * new if _ > 10 else new
    return w


@dataclass
class ToxicityModel:
    table: np.ndarray  # weight of each triple
    bias: float
    logistic: np.ndarray

    def stretches(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The highest decision of the stretches that begin at each word, and the number of words of that one."""
        total, norm = np.zeros(len(w.symbols)), np.zeros(len(w.symbols))
        for at, f, x in triples(w):
            total[at] += x * self.table[f]
            norm[at] += x * x
        n = len(w.start)
        total = np.concatenate([[0.0], np.cumsum(np.add.reduceat(total, w.start))])
        norm = np.concatenate([[0.0], np.cumsum(np.add.reduceat(norm, w.start))])
        end = np.searchsorted(w.sentence, w.sentence, "right")  # of each word's sentence
        best, size, here = np.full(n, -np.inf), np.ones(n, np.int64), np.arange(n)
        for scale in SCALES:
            to = np.minimum(here + scale, end)
            d = (total[to] - total[here]) / np.sqrt(np.maximum(norm[to] - norm[here], 1.0)) + self.bias
            more = d > best
            best[more], size[more] = d[more], (to - here)[more]
        return best, size

    def features(self, texts: list[str]) -> np.ndarray:
        """By text: highest decision, stretches above three levels (logarithms), number of words (logarithm)."""
        out = np.zeros((len(texts), FEATURES))
        out[:, 0] = -1.0
        w = words_of(texts)
        if not len(w.start):
            return out
        d, _ = self.stretches(w)
        first = np.flatnonzero(np.diff(w.text, prepend=-1))
        row = w.text[first]
        out[row, 0] = np.clip(np.maximum.reduceat(d, first), -1, 1.2)
        for k, level in enumerate((0.0, 0.3, 0.6)):
            out[row, 1 + k] = np.log1p(np.add.reduceat((d > level).astype(float), first))
        out[row, 4] = np.log1p(np.diff(first, append=len(d)))
        return out

    def highest(self, texts: list[str]) -> list[str | None]:
        """The highest stretch of each text."""
        out: list[str | None] = [None] * len(texts)
        w = words_of(texts)
        if len(w.start):
            d, size = self.stretches(w)
            first = np.flatnonzero(np.diff(w.text, prepend=-1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(d)]):
                k = a + int(d[a:b].argmax())
                out[w.text[k]] = texts[w.text[k]][w.first[k] : w.last[k + size[k] - 1] + 1]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic[:-1] + self.logistic[-1], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def _drawn(texts: list[str], seed: int) -> list[list[str]]:
    """DRAWN stretches of each text, of the scales in turn, beginning at words chosen by a hash of text and seed."""
    out: list[list[str]] = [[] for _ in texts]
    w = words_of(texts)
    if not len(w.start):
        return out
    end = np.searchsorted(w.sentence, w.sentence, "right")
    first = np.flatnonzero(np.diff(w.text, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(w.start)]):
        text = texts[w.text[a]]
        for k in range(DRAWN):
            i = a + zlib.crc32(f"{seed} {k} {text}".encode()) % (b - a)
            out[w.text[a]].append(text[w.first[i] : w.last[min(i + SCALES[k % len(SCALES)], end[i]) - 1] + 1])
    return out


def _stretches(texts: DataFrame, model: ToxicityModel | None, seed: int) -> pd.DataFrame:
    """(toxic, stretch) of the labelled texts: drawn ones and, with a model, each text's highest one. A bounded table."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, at = batch.column(1).to_pylist(), 0
            for part in _in_groups(batch.column(0).to_pylist()):
                rows = [(toxic[at + k], x, False) for k, xs in enumerate(_drawn(part, seed)) for x in xs]
                if sent.value is not None:
                    rows += [(toxic[at + k], x, True) for k, x in enumerate(sent.value.highest(part)) if x is not None]
                at += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.bool_()))] if rows else [pa.array([], t) for t in (pa.int32(), pa.string(), pa.bool_())], ["toxic", "stretch", "top"])

    return texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, stretch string, top boolean").toPandas()


def _landmarks(texts: DataFrame, n1: int, n0: int) -> list[str]:
    """Words of the labelled sentences: those most typical of toxic texts (by the log-likelihood of their counts of
    texts), the most frequent of the others, and some of the others by a hash. Counted in Spark."""
    words = texts.select("doc_id", "toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).filter(F.length("word").between(2, 40)).distinct()
    counts = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    lift = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    counts = materialize(counts.withColumns({"lift": lift, "gain": F.col("t") * lift}), "words")
    top = counts.filter("t >= 2 and lift > 0").orderBy(F.desc("gain"), "word").limit(LANDMARKS // 2)
    rest = counts.filter("c > 0 and lift < 1")
    often, some = rest.orderBy(F.desc("c"), "word").limit(LANDMARKS // 4), rest.orderBy(F.xxhash64("word"), "word").limit(LANDMARKS // 4)
    return list(dict.fromkeys(r.word for df in (top, often, some) for r in df.select("word").collect()))  # LANDMARKS rows


def _fit(rows: pd.DataFrame, marks: list[str], half_inverse: np.ndarray) -> ToxicityModel:
    y = rows.toxic.to_numpy() * 2.0 - 1
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    z = np.column_stack([kernel(rows.stretch.tolist(), marks) @ half_inverse, np.ones(len(y))])
    w = _newton(z, y, weight)
    alpha = half_inverse @ w[:-1]
    i, f, v = vectors(marks)
    return ToxicityModel(np.bincount(f, v * alpha[i], 1 << 18).astype(np.float32), float(w[-1]), np.zeros(FEATURES + 1))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE_DOCS, seed: int = 11) -> ToxicityModel:
    """A model from texts whose label `toxic` is 0 or 1 and for whose doc_id `learn` holds.

    About `sample` labelled texts of each class are used (the documented bound). A doc_id with both labels counts as
    toxic, one that occurs with several texts labels them all. With one class only, the model scores that class's share
    (0 or 1) of all labels, 0 without labels.
    """
    small_batches(docs.sparkSession)
    labels = labels.filter(F.col("toxic").isin(0, 1) & learn & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel(np.zeros(1 << 18, np.float32), -1.0, np.array([0.0] * FEATURES + [30.0 if 1 in sizes else -30.0]))
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chosen = materialize(labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000), "toxic")
    texts = materialize(join_small(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), chosen, "doc_id", "inner"), "labelled")
    n1, n0 = (texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("c")).first())
    marks = _landmarks(texts, n1, n0)
    drawn = _stretches(texts, None, seed)
    if not marks or drawn.toxic.nunique() < 2:
        return ToxicityModel(np.zeros(1 << 18, np.float32), -1.0, np.array([0.0] * FEATURES + [float(np.log((n1 + 0.5) / (n0 + 0.5)))]))
    vals, vecs = np.linalg.eigh(kernel(marks, marks))
    half_inverse = vecs * (1 / np.sqrt(np.maximum(vals, 1e-4))) @ vecs.T
    model = _fit(drawn, marks, half_inverse)
    for k in range(ROUNDS):
        rows = _stretches(texts, model, seed + k + 1)
        model = _fit(rows[rows.top | (rows.toxic == 0)], marks, half_inverse)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.vstack([sent.value.features(t) for t in _in_groups(batch.column(0).to_pylist())] or [np.zeros((0, FEATURES))])
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c) for c in x.T]], ["toxic", *[f"x{k}" for k in range(FEATURES)]])

    got = texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(featured, "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toPandas()
    model.logistic = _logistic(got[[f"x{k}" for k in range(FEATURES)]].to_numpy(), got.toxic.to_numpy().astype(float))
    return model


def _in_groups(texts: list[str | None]) -> Iterator[list[str]]:
    texts = [t or "" for t in texts]
    off = np.cumsum([0, *map(len, texts)])
    for a, b in text_groups(off, 500_000):
        yield texts[a:b]


def score_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); null counts as empty, which has a text without words'
    score. Columns of those names are replaced."""
    docs = docs.drop("score", "predicted")
    names, at = docs.columns, docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate([sent.value.score(t) for t in _in_groups(batch.column(at).to_pylist())] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
