"""LM scoring with a probabilistic suffix tree over the bytes of the text, and a word unigram base.

Bytes (A-Z lower-cased) are put into 64 classes: the end of a text, the 62 most frequent bytes, all others. A context is
a state if its next-symbol distribution diverges from that of its suffix: if the log-likelihood that it gains exceeds
MIN_DIVERGENCE and what its own distribution costs to state, half a logarithm of its count for each symbol that follows
it. Contexts of one to four classes are all tested; a longer one if its suffix is a state and its count at least an
eighth of the square root of the number of symbols, without a greatest depth: so the number of states grows with the
corpus, as its square root, and the probability below which a context is not looked at falls with it. A state's distribution is smoothed towards that of its longest suffix state. A text is scored by the longest suffix state
at each place. All counts are Spark aggregates over all training texts. All states stay in written tables; a bounded
number of them is broadcast, the others are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volley.llm.shared import LOWER_BYTES, give_back, materialize, mix64, small_batches, text_buffer, text_groups, top_counts, word_hashes

DEPTH, CLASSES = 4, 64
#: Depth up to which a key is the context itself, six bits a class; beyond, it is a hash.
EXACT = 9
#: Depths of one pass over the texts: more at once the rarer the contexts become.
PASSES = [(5, 6), (7, 8), (9, 12)]
END, OTHER = 0, 63
#: The least gain (nats) beyond the cost of a state, and count of a state; the share of the square root of the number of
#: symbols that a longer context's count must reach; smoothing mass.
MIN_DIVERGENCE, MIN_COUNT, ROOT_SHARE, MASS = 10.0, 20, 0.125, 8.0
#: States of at most DEPTH classes in the broadcast tree, and broadcast states beside it (others are joined); size of
#: the bitmap that spares most places a look-up.
STATES, HOT_STATES, BITS = 60_000, 100_000, 1 << 24
COMMON_WORDS = 300_000
END_WORD = np.uint64(0x5BD1E9955BD1E995)
#: Bounds of a worker's memory: bytes of text taken at once; different keys that it sums up; rows it passes on at once.
_GROUP, _GATHER, _ROWS = 1_000_000, 1_000_000, 100_000


def _classes(counts: dict[int, int]) -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for k, b in enumerate(sorted(counts, key=lambda b: (-counts[b], b))[: CLASSES - 2]):
        out[b] = k + 1
    return out


def sequence(raw: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the texts on end, each after DEPTH ENDs and with one END after it; and which places are symbols
    to predict."""
    n = len(off) - 1
    last = off[1:] + np.arange(n) * (DEPTH + 1) + DEPTH
    text = np.ones(len(raw) + n * (DEPTH + 1), bool)
    text[last] = False
    asked = text.copy()
    asked[last] = True
    for k in range(1, DEPTH + 1):
        at = last - np.diff(off) - k
        text[at] = asked[at] = False
    seq = np.zeros(len(text), np.uint8)
    seq[text] = classes[LOWER_BYTES][raw]
    return seq, asked


def rows_of(at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The text of each place."""
    return np.searchsorted(off[1:] + np.arange(len(off) - 1) * (DEPTH + 1) + DEPTH, at, "left")


def codes(seq: np.ndarray) -> np.ndarray:
    """The DEPTH classes before each place, 6 bits each, the nearest lowest; of no meaning for the first places."""
    out = np.zeros(len(seq), np.uint32)
    for k in range(DEPTH, 0, -1):
        out <<= np.uint32(6)
        out[k:] |= seq[:-k]
    return out


def keys(seq: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Context of DEPTH classes and the symbol, 6 bits each, the symbol lowest, of the places asked for."""
    out = codes(seq) << np.uint32(6)
    out |= seq
    return out[asked]


def longer(seq: np.ndarray, at: np.ndarray, key: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places can have a context of d > DEPTH classes, and its keys; key: those of the contexts of d - 1.
    A context ends with the first END to the left. Up to EXACT classes a key is the context and its depth."""
    on = np.flatnonzero(seq[at - (d - 1)] > 0)
    at, key = at[on], key[on]
    c = seq[at - d].astype(np.int64)
    if d <= EXACT:
        return on, (key & ((1 << 6 * (d - 1)) - 1)) | c << 6 * (d - 1) | d << 6 * EXACT
    h = mix64(mix64(key.view(np.uint64) + np.uint64(d)) ^ (c + 1).view(np.uint64))
    return on, ((h >> np.uint64(8) << np.uint64(6)) | np.uint64(1 << 62)).view(np.int64)


def shallow_keys(code: np.ndarray, d: int) -> np.ndarray:
    return (code.astype(np.int64) & ((1 << 6 * d) - 1)) | d << 6 * EXACT


def context_keys(code: np.ndarray, d: int) -> np.ndarray:
    """The d classes before each place, at most EXACT, without the depth; code: the DEPTH classes before each place."""
    out = code.astype(np.int64)
    for k in range(DEPTH, d, DEPTH):
        out[k:] |= code[:-k].astype(np.int64) << 6 * k
    out &= (1 << 6 * d) - 1
    return out


def _places(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - BITS.bit_length())).view(np.int64)


def _bitmap(states: DataFrame, direct: bool = False) -> np.ndarray:
    """Packed bits of the states' keys (direct: of their DEPTH classes, exact); a set bit may be another key's, so what
    passes is looked up again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            bit = key & (BITS - 1) if direct else _places(key)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))], ["at", "bit"])

    got = states.select("key").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # BITS / 64 rows at most
    words = np.zeros(BITS >> 6, np.int64)
    words[got["at"].to_numpy()] = got["bits"].to_numpy()
    return words.view(np.uint8)


def _has(packed: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (packed[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).view(bool)


def _begins(code: np.ndarray, states: np.ndarray, d: int) -> np.ndarray:
    """The places whose context of d classes (DEPTH to EXACT) is a state by the bitmap."""
    return _has(states, code.astype(np.int64) if d == DEPTH else _places(context_keys(code, d) | d << 6 * EXACT))


class Slots:
    """A hash table of 64-bit keys, looked up for many at once."""

    def __init__(self, keys: np.ndarray):
        self.mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.key, self.value = np.zeros(self.mask + 1, np.int64), np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = np.flatnonzero(self.value[at] < 0)
            self.value[at[free]] = left[free]  # of several for one place the last is in
            self.key[at[free]] = keys[left[free]]
            out = self.value[at] != left
            left, at = left[out], (at[out] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it isn't there."""
        out, at, left = np.full(len(keys), -1), self._place(keys), np.arange(len(keys))
        while len(left):
            value = self.value[at]
            same = (self.key[at] == keys[left]) & (value >= 0)
            out[left[same]] = value[same]
            on = ~same & (value >= 0)
            left, at = left[on], (at[on] + 1) & self.mask
        return out


@dataclass
class DeepStates:
    """Broadcast states outside the tree: their keys, and delta, log10 of p over the suffix state's p."""

    keys: np.ndarray
    delta: np.ndarray
    depths: list[int]  # of all states outside the tree
    packed: np.ndarray
    whole: bool  # no state is left to the join

    def add(self, slots: Slots, seq: np.ndarray, asked: np.ndarray, code: np.ndarray, on: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the broadcast states add to each text's score; and (row, key, symbol) of the places left to the join.
        on: the places whose context of DEPTH classes is a state, as far as the tree can tell."""
        left, add = [], np.zeros(len(seq))
        at, key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for d in range(1, max(self.depths, default=0) + 1):
            if d > DEPTH:
                keep, key = longer(seq, at, key, d)
                at = at[keep]
            elif d in self.depths:
                at = np.flatnonzero(asked)
                key = shallow_keys(code[at], d)
            elif d == DEPTH:
                at = np.flatnonzero(on)
                key = shallow_keys(code[at], d)
                continue
            else:
                continue
            hit = np.flatnonzero(_has(self.packed, _places(key)))
            found = slots.find(key[hit])
            known = np.flatnonzero(found >= 0)
            place = at[hit[known]]
            add[place] += self.delta[found[known], seq[place]]
            if not self.whole:
                cold = hit[found < 0]
                left.append((rows_of(at[cold], off), key[cold], seq[at[cold]].astype(np.int64)))
                known = np.arange(len(hit))
            go = hit[known]
            if d == DEPTH:
                go = np.union1d(go, np.flatnonzero(on[at]))
            if d >= DEPTH:
                at, key = at[go], key[go]
        if not left:
            left = [(np.zeros(0, np.int64),) * 3]
        total = np.add.reduceat(add, off[:-1] + np.arange(len(off) - 1) * (DEPTH + 1))
        return total, *(np.concatenate(x) for x in zip(*left))


@dataclass
class SuffixTree:
    classes: np.ndarray
    states: list[np.ndarray]  # by depth, the retained contexts
    log_p: np.ndarray  # (state, class), log10; states in order of depth, the root first
    within_other: np.ndarray  # log10 probability of a byte within OTHER

    def transitions(self) -> np.ndarray:
        """For each context of DEPTH classes its longest suffix that is a state."""
        out, first = np.zeros(CLASSES**DEPTH, np.uint16), 1
        for d, ctx in enumerate(self.states, 1):
            out.reshape(-1, CLASSES**d)[:, ctx] = np.arange(first, first + len(ctx), dtype=np.uint16)
            first += len(ctx)
        return out

    def score(self, raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
        seq, asked = sequence(raw, off, self.classes)
        return self.score_places(raw, off, seq, np.flatnonzero(asked), table[codes(seq)[asked]])

    def score_places(self, raw: np.ndarray, off: np.ndarray, seq: np.ndarray, at: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The texts' scores, given the longest state of the tree at each place."""
        ends = np.flatnonzero(seq[at] == END) + 1  # each text's last place is its END
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        p = self.log_p.ravel()[state.astype(np.int32) * CLASSES + seq[at]]
        total = np.add.reduceat(p, first, dtype=np.float64) if len(first) else np.zeros(0)
        odd = np.flatnonzero((self.classes == OTHER)[LOWER_BYTES][raw])
        return total + np.bincount(np.searchsorted(off, odd, "right") - 1, self.within_other[LOWER_BYTES[raw[odd]]], len(off) - 1)


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


class Sums:
    """Counts of keys, summed until there are _GATHER different ones."""

    def __init__(self):
        self.keys, self.n, self.held, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes an array of keys; (keys, counts) that have become too many to hold, by key."""
        self.held.append(part.view(np.uint64))
        self.size += len(part)
        if self.size > 2 * _GATHER:
            self._merge()
            if len(self.keys) > _GATHER:
                yield from self._out()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._merge()
        yield from self._out()

    def _merge(self) -> None:
        part = np.sort(np.concatenate(self.held or [np.zeros(0, np.uint64)]))
        self.held, self.size = [], 0
        first = _firsts(part)
        keys, n = np.concatenate([self.keys, part[first]]), np.concatenate([self.n, np.diff(first, append=len(part))])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = _firsts(keys)
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(first) else n

    def _out(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, n = self.keys, self.n
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for a in range(0, len(keys), _ROWS):
            yield keys[a : a + _ROWS], n[a : a + _ROWS]


def _summed(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of arrays of keys, summed as far as they can be held."""
    sums = Sums()
    for part in parts:
        yield from sums.add(part)
    yield from sums.rest()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, off = text_buffer(batch.column(0))
        for a, b in text_groups(off, _GROUP):
            yield raw[off[a] : off[b]], off[a : b + 1] - off[a]
            give_back()


def _count(kind: str, docs: DataFrame, classes: np.ndarray | None = None) -> DataFrame:
    """(what, key, n): words (what 0, by hash) and bytes (what 1); or with classes, symbols after contexts (what 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, np.int64)

        def parts() -> Iterator[np.ndarray]:
            for raw, off in _groups(batches):
                if classes is None:
                    seen[:] += np.bincount(LOWER_BYTES[raw], minlength=256)
                    yield np.append(word_hashes(raw, off)[1], np.full(len(off) - 1, END_WORD))
                else:
                    yield keys(*sequence(raw, off, classes)).astype(np.uint64)

        def rows(what: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), what, np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["what", "key", "n"])

        for key, n in _summed(parts()):
            yield rows(0 if classes is None else 2, key.view(np.int64), n)
        yield rows(1, np.flatnonzero(seen), seen[seen > 0])

    return materialize(docs.select("text").mapInArrow(run, "what int, key long, n long").groupBy("what", "key").agg(F.sum("n").alias("n")), kind)


def _gain() -> Column:
    """What a context's own distribution gains over its suffix's (m: symbol to count, all: their sum), less its cost."""
    gain = F.aggregate("seen", F.lit(0.0), lambda s, x: s + x["n"] * F.log(x["n"] / F.col("total") * F.col("all") / F.try_element_at("m", x["sym"])))
    return gain - F.size("seen") * 0.5 * F.log("total")


def _shallow(docs: DataFrame, classes: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(d, ctx, total, seen: (sym, n)) of all contexts of at most DEPTH classes met MIN_COUNT times; those that are
    states, without d 0; and (key, n), the counts of all strings of DEPTH + 1 classes."""
    full = _count("contexts", docs, classes)
    grams = full.select(F.shiftright("key", 6).alias("ctx"), F.col("key").bitwiseAND(63).alias("sym"), "n")
    seen = []
    for d in range(DEPTH, -1, -1):  # each depth is summed from the one above
        if d < DEPTH:
            grams = materialize(grams.groupBy(F.col("ctx").bitwiseAND((1 << 6 * d) - 1).alias("ctx"), "sym").agg(F.sum("n").alias("n")), "grams")
        seen.append(_seen(grams.withColumn("d", F.lit(d)), "d", "ctx").filter((F.col("total") >= MIN_COUNT) | (F.col("d") == 0)))
    seen = [materialize(x, "seen") for x in seen[::-1]]
    kept = []
    for d in range(1, DEPTH + 1):
        above = seen[d - 1].select(F.col("ctx").alias("up"), F.map_from_entries("seen").alias("m"), F.col("total").alias("all"))
        rows = seen[d].withColumn("up", F.col("ctx").bitwiseAND((1 << 6 * (d - 1)) - 1)).join(above.hint("merge"), "up")
        kept.append(rows.filter(_gain() >= MIN_DIVERGENCE).select("d", "ctx", "total", "seen"))
    out, states = seen[0], kept[0]
    for x, y in zip(seen[1:], kept[1:] + [None]):
        out, states = out.unionByName(x), states if y is None else states.unionByName(y)
    return out, materialize(states, "states"), full.select("key", "n")


def _first(kept: DataFrame, states: int) -> DataFrame:
    """The tree's states, those met most often: so each suffix state of one of them is in the tree too."""
    return top_counts(kept, "total", states).select("d", "ctx")


def _tree(docs: DataFrame, byte_counts: dict[int, int], states: int) -> SuffixTree:
    seen, kept, _ = _shallow(docs, _classes(byte_counts))
    return _build(seen, kept, _first(kept, states), byte_counts)


def _build(seen: DataFrame, kept: DataFrame, first_states: DataFrame, byte_counts: dict[int, int]) -> SuffixTree:
    classes = _classes(byte_counts)
    inside = kept.join(F.broadcast(first_states), ["d", "ctx"], "left_semi").unionByName(seen.filter("d = 0"))  # a bounded number of contexts
    rows = inside.select("d", "ctx", F.explode("seen").alias("x")).select("d", "ctx", "x.*").toArrow().to_pandas()

    order = [np.unique(rows.ctx[rows.d == d].to_numpy()) for d in range(1, DEPTH + 1)]
    first = np.cumsum([1, *map(len, order)])
    p = np.zeros((first[-1], CLASSES))
    n0 = np.bincount(rows.sym[rows.d == 0], rows.n[rows.d == 0], CLASSES)
    p[0] = (n0 + 0.5) / (n0.sum() + 0.5 * CLASSES)
    for d in range(1, DEPTH + 1):
        part, ctx = rows[rows.d == d], order[d - 1]
        n = np.zeros((len(ctx), CLASSES))
        np.add.at(n, (np.searchsorted(ctx, part.ctx), part.sym), part.n)
        suffix = np.zeros(len(ctx), np.int64)
        for e in range(1, d):
            if len(order[e - 1]):
                low = ctx & (CLASSES**e - 1)
                k = np.minimum(np.searchsorted(order[e - 1], low), len(order[e - 1]) - 1)
                suffix = np.where(order[e - 1][k] == low, first[e - 1] + k, suffix)
        p[first[d - 1] : first[d]] = (n + MASS * p[suffix]) / (n.sum(1, keepdims=True) + MASS)
    odd = np.array([byte_counts.get(b, 0) + 1.0 if classes[b] == OTHER else 0.0 for b in range(256)])
    return SuffixTree(classes, order, np.log10(p).astype(np.float32), np.log10(np.maximum(odd / max(odd.sum(), 1), 1e-300)))


def _smoothed(rows: DataFrame, above: DataFrame) -> DataFrame:
    """State rows (d, key, total, n: symbol to count, p: symbol to probability, delta: symbol to log10 of p over the
    suffix state's p, unseen: the same of a symbol not met) of rows (d, key, up, total, seen: (sym, n))."""
    q = above.select(F.col("key").alias("up"), F.col("p").alias("q"))
    out = rows.join(q.hint("merge"), "up")
    p = F.transform("seen", lambda x: (x["n"] + MASS * F.try_element_at("q", x["sym"])) / (F.col("total") + MASS))
    out = out.withColumns({"syms": F.transform("seen", lambda x: x["sym"]), "ps": p})
    delta = F.zip_with("seen", "ps", lambda x, y: F.log10(y / F.try_element_at("q", x["sym"])))
    n = F.map_from_arrays("syms", F.transform("seen", lambda x: x["n"]))
    return out.select("d", "key", "total", n.alias("n"), F.map_from_arrays("syms", "ps").alias("p"), F.map_from_arrays("syms", delta).alias("delta"), F.log10(MASS / (F.col("total") + MASS)).alias("unseen"))


def _seen(rows: DataFrame, *by: str) -> DataFrame:
    """(by, total, seen) of rows (by, sym, n), one for each context: at most CLASSES symbols."""
    return rows.groupBy(*by).agg(F.sum("n").alias("total"), F.collect_list(F.struct("sym", "n")).alias("seen"))


def _shallow_states(root: DataFrame, kept: DataFrame) -> list[DataFrame]:
    """State rows by depth 0 to DEPTH, of all states of `kept`."""
    key = (F.col("d").cast("long") * F.lit(1 << 6 * EXACT)).bitwiseOR(F.col("ctx"))
    every = F.sequence(F.lit(0), F.lit(CLASSES - 1))
    n = F.map_from_entries("seen")
    root = root.select(F.col("d").cast("int").alias("d"), F.lit(0).cast("long").alias("key"), "total", n.alias("n"), F.map_from_arrays(every.cast("array<long>"), F.transform(every, lambda s: (F.coalesce(F.try_element_at(n, s.cast("long")), F.lit(0)) + 0.5) / (F.col("total") + 0.5 * CLASSES))).alias("p"))
    root = root.withColumns({"delta": F.col("p"), "unseen": F.lit(0.0)})
    out = [materialize(root, "depth-0")]
    seen = kept.withColumn("key", key)
    suffix = F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("e")
    low = seen.select("key", "ctx", "d", suffix).withColumn("up", F.when(F.col("e") == 0, 0).otherwise((F.col("e").cast("long") * F.lit(1 << 6 * EXACT)).bitwiseOR(F.col("ctx").bitwiseAND(F.expr("shiftleft(1L, 6 * e) - 1")))))
    known = seen.select(F.col("key").alias("up")).unionByName(out[0].select(F.col("key").alias("up")))
    up = low.join(known.hint("merge"), "up", "left_semi").groupBy("key").agg(F.max_by("up", "e").alias("up"))
    seen = materialize(seen.join(up.hint("merge"), "key"), "suffixes")
    above = out[0]
    for d in range(1, DEPTH + 1):
        rows = seen.filter(F.col("d") == d).withColumn("d", F.col("d").cast("int"))
        out.append(materialize(_smoothed(rows, above).select(*out[0].columns), f"depth-{d}"))
        above = above.unionByName(out[-1])
    return out


@dataclass
class Strings:
    """What is known of strings of `size` classes: a bitmap of those met often enough, so that no context that holds
    another one is; but only of those whose last class but one ends a context of `d` classes that is in the bitmap
    `counted` (None: of all)."""

    size: int
    often: np.ndarray
    counted: np.ndarray | None = None
    d: int = DEPTH

    def possible(self, code: np.ndarray) -> np.ndarray:
        """For each place, whether the string of `size` classes before it may be part of a context met often enough."""
        out = _has(self.often, _places(context_keys(code, self.size)))
        if self.counted is not None:
            out[1:] |= ~_begins(code, self.counted, self.d)[:-1]
        return out


def _context_rows(batches: Iterator[pa.RecordBatch], classes: np.ndarray, starts: np.ndarray, deep: np.ndarray, strings: Strings, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """(d, key, up, n, pairs) of the contexts of low to high classes in the texts whose suffix of low - 1 classes is a
    state: one row a context for all that can be held, with its count and (count << 6 | symbol) for each symbol that
    follows. up is null where the key itself tells it. The walk begins at the places whose context of low - 1 classes
    (EXACT at most) is a state by the bitmap `starts`; `deep` is that of all states beyond DEPTH."""
    begin = min(low - 1, EXACT)
    sums, hashed, held = Sums(), [], 0
    inside = (1 << 6 * EXACT) - 1

    def rows(d: np.ndarray, key: np.ndarray, up: np.ndarray | None, first: np.ndarray, sym: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        pairs = pa.ListArray.from_arrays(pa.array(np.append(first, len(n)).astype(np.int32)), pa.array(n << 6 | sym))
        up = pa.nulls(len(d), pa.int64()) if up is None else pa.array(up)
        return pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(key), up, pa.array(np.add.reduceat(n, first)), pairs], ["d", "key", "up", "n", "pairs"])

    def exact_rows(got: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for key, n in got:
            first = _firsts(key >> np.uint64(6))
            d = (key[first] >> np.uint64(60)).astype(np.int64)
            key = key.view(np.int64)
            yield rows(d, key[first] >> 6 & inside | d << 6 * EXACT, None, first, key & 63, n)

    def hashed_rows() -> Iterator[pa.RecordBatch]:
        if hashed:
            packed, n, d, up = (np.concatenate(x) for x in zip(*hashed))
            order = np.argsort(packed, kind="stable")
            first = _firsts(packed[order])
            n, order = np.add.reduceat(n[order], first), order[first]
            packed = packed[order]
            first = _firsts(packed >> 6)
            one = order[first]
            yield rows(d[one], packed[first] & ~63, up[one], first, packed & 63, n)
        hashed.clear()

    for raw, off in _groups(batches):
        seq, asked = sequence(raw, off, classes)
        code = codes(seq)
        possible = strings.possible(code)
        at = np.flatnonzero(_begins(code, starts, begin) & asked)
        key, out = context_keys(code, begin)[at] | begin << 6 * EXACT, []
        for d in range(begin + 1, high + 1):
            on = np.flatnonzero(possible[at - (d - strings.size)])
            at, key = at[on], key[on]
            up = key
            on, key = longer(seq, at, key, d)
            at, up = at[on], up[on]
            if d < low:
                on = np.flatnonzero(_has(deep, _places(key)))
                at, key = at[on], key[on]
            elif d <= EXACT:
                out.append(((key & inside) << 6 | seq[at]).view(np.uint64) | np.uint64(d << 60))
            elif len(at):
                packed, one, n = np.unique(key & ~63 | seq[at], return_index=True, return_counts=True)
                hashed.append((packed, n, np.full(len(one), d), up[one]))
                held += len(one)
        if out:
            yield from exact_rows(sums.add(np.concatenate(out)))
        if held > _GATHER // 2:
            yield from hashed_rows()
            held = 0
    yield from exact_rows(sums.rest())
    yield from hashed_rows()


def _counted(docs: DataFrame, classes: np.ndarray, starts: np.ndarray, deep: np.ndarray, strings: Strings, low: int, high: int, least: float) -> DataFrame:
    """(d, key, up, total, seen) of the contexts of low to high classes whose suffix of low - 1 classes is a state, met
    `least` times. Tasks send a row a context, with the symbols in an array; these are looked into only where the
    contexts' counts reach `least`."""
    sent = docs.sparkSession.sparkContext.broadcast((classes, starts, deep, strings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _context_rows(batches, *sent.value, low, high)

    got = docs.select("text").mapInArrow(run, "d int, key long, up long, n long, pairs array<long>").repartition(F.col("key"))
    whole = got.groupBy("d", "key", "up").agg(F.sum("n").alias("total"), F.flatten(F.collect_list("pairs")).alias("pairs")).filter(F.col("total") >= least)
    pairs = whole.select("d", "key", "up", F.explode("pairs").alias("x"))
    seen = _seen(pairs.groupBy("d", "key", "up", F.col("x").bitwiseAND(63).alias("sym")).agg(F.sum(F.shiftright("x", 6)).alias("n")), "d", "key", "up")
    own = F.expr(f"(key & (shiftleft(1L, 6 * (d - 1)) - 1)) | shiftleft(cast(d - 1 as long), {6 * EXACT})")
    return materialize(seen.withColumn("up", F.coalesce("up", own)), f"counts-{low}")


def _deep_states(docs: DataFrame, classes: np.ndarray, root: DataFrame, kept: DataFrame, first: DataFrame, strings: DataFrame, symbols: int) -> tuple[DataFrame, list[int]]:
    """State rows of all states outside the tree, and their depths."""
    least = max(MIN_COUNT, ROOT_SHARE * symbols**0.5)
    known = Strings(DEPTH + 1, _bitmap(strings.filter(F.col("n") >= least)))
    by_depth = _shallow_states(root, kept)
    outside, depths = by_depth[0].limit(0), []
    for d in range(1, DEPTH + 1):
        inside = first.filter(F.col("d") == d).select((F.lit(d << 6 * EXACT).cast("long").bitwiseOR(F.col("ctx"))).alias("key"))
        more = by_depth[d].join(F.broadcast(inside), "key", "left_anti").select(*by_depth[0].columns)
        if not more.isEmpty():
            outside, depths = outside.unionByName(more), [*depths, d]
    above, (low, high), blocks = by_depth[DEPTH], (0, DEPTH), iter(PASSES)
    starts, deep = _bitmap(above, direct=True), np.zeros(BITS >> 3, np.uint8)
    while True:
        low, high = next(blocks, (high + 1, 2 * high))
        rows = _counted(docs, classes, starts, deep, known, low, high, least)
        if high < EXACT:
            pairs = rows.filter(F.col("d") == high).select("key", F.explode("seen").alias("x")).filter(F.col("x.n") >= least)
            often = _bitmap(pairs.select(F.shiftleft(F.col("key").bitwiseAND((1 << 6 * high) - 1), 6).bitwiseOR(F.col("x.sym")).alias("key")))
            known = Strings(high + 1, often, starts, low - 1)
        for d in range(low, high + 1):
            suffix = above.select(F.col("key").alias("up"), F.col("n").alias("m"), F.col("total").alias("all"))
            states = rows.filter(F.col("d") == d).join(suffix.hint("merge"), "up").filter(_gain() >= MIN_DIVERGENCE).drop("m", "all")
            above = materialize(_smoothed(states, above).select(*above.columns), f"depth-{d}")
            if above.isEmpty():
                return outside, depths
            outside, depths = outside.unionByName(above), [*depths, d]
            deep = deep | _bitmap(above)
        starts = deep


def _split(outside: DataFrame, depths: list[int], hot: int) -> tuple[DeepStates, DataFrame]:
    """The states met most often, at most `hot`, to broadcast; and all the others."""
    count = outside.count()
    if not count:
        return DeepStates(np.zeros(0, np.int64), np.zeros((0, CLASSES), np.float32), [], np.zeros(BITS >> 3, np.uint8), True), outside
    top = outside if count <= hot else materialize(top_counts(outside, "total", hot), "hot")
    rows = top.select("key", "unseen", F.map_keys("delta").alias("syms"), F.map_values("delta").alias("values")).toArrow().combine_chunks()
    key = rows["key"].to_numpy()
    delta = np.repeat(rows["unseen"].to_numpy().astype(np.float32)[:, None], CLASSES, 1)
    if len(key):
        size = rows["syms"].combine_chunks().value_lengths().to_numpy()
        delta[np.repeat(np.arange(len(key)), size), rows["syms"].combine_chunks().flatten().to_numpy()] = rows["values"].combine_chunks().flatten().to_numpy()
    cold = outside if count <= hot else outside.join(F.broadcast(top.select("key")), "key", "left_anti")
    return DeepStates(key, delta, depths, _bitmap(outside), count <= hot), cold


def score_documents(docs: DataFrame, learn: Column, states: int = STATES, common: int = COMMON_WORDS, hot: int = HOT_STATES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    The tree and the word counts are learned from the rows for which `learn` holds (a null text counts as empty; with
    none, base counts are 0 and the tree is uniform). `states` and `hot` only say how many states are broadcast; those
    beyond are joined by their key. Tokens are runs without ASCII white space, and one end. Word
    counts of the `common` most frequent words are broadcast (the documented bound); the others are joined by their
    64-bit hash. Repeated rows and null ids are scored like any other.
    """
    small_batches(docs.sparkSession)
    words = _count("words", docs.filter(learn))
    counts = words.filter("what = 0").select(F.col("key").alias("h"), F.col("n").alias("c"))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    byte_counts = {r.key: r.n for r in words.filter("what = 1").collect()}
    seen, kept, strings = _shallow(docs.filter(learn), _classes(byte_counts))
    first = materialize(_first(kept, states), "first")
    tree = _build(seen, kept, first, byte_counts)
    outside, depths = _deep_states(docs.filter(learn), tree.classes, seen.filter("d = 0"), kept, first, strings, sum(byte_counts.values()))
    deep, cold = _split(outside, depths, hot)
    top = top_counts(counts, "c", common).toArrow()
    top_h, top_c = top["h"].to_numpy(), top["c"].to_numpy()
    order = np.argsort(top_h)
    sent = docs.sparkSession.sparkContext.broadcast((tree, deep, top_h[order], top_c[order]))
    scale, whole = float(np.log10(total + distinct + 1)), distinct <= common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, deep, hs, cs = sent.value
        slots, words = Slots(deep.keys), Slots(hs)
        table, log_c = tree.transitions(), np.append(np.log10(cs + 1.0), 0.0)
        inner = 1 + sum(map(len, tree.states[:-1]))
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for a, b in text_groups(off, _GROUP):
                part, places, m = raw[off[a] : off[b]], off[a : b + 1] - off[a], b - a
                row, h = word_hashes(part, places)
                row, h = np.append(row, np.arange(m)), np.append(h, np.full(m, END_WORD)).view(np.int64)
                found = words.find(h)
                hit, value = found >= 0, log_c[found]
                rare_at = np.zeros(0, int) if whole else np.flatnonzero(~hit)
                rare_at = rare_at[np.argsort(row[rare_at], kind="stable")]
                ends = np.searchsorted(row[rare_at], np.arange(m + 1))
                rare = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[rare_at]))
                seq, asked = sequence(part, places, tree.classes)
                code = codes(seq)
                state = table[code]
                score = tree.score_places(part, places, seq, np.flatnonzero(asked), state[asked])
                more, far, key, sym = deep.add(slots, seq, asked, code, (state >= inner) & asked, places)
                far_at = np.argsort(far, kind="stable")
                ends = pa.array(np.searchsorted(far[far_at], np.arange(m + 1)).astype(np.int32))
                far_keys, far_syms = (pa.ListArray.from_arrays(ends, pa.array(x[far_at])) for x in (key, sym))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), pa.array(np.bincount(row, minlength=m)), pa.array(np.bincount(row, hit, m).astype(np.int64)), pa.array(np.bincount(row, value, m)), pa.array(score + more), rare, far_keys, far_syms], ["doc_id", "n_tokens", "known", "logs", "score", "rare", "far", "syms"])
                give_back()

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "known")], *[T.StructField(c, T.DoubleType()) for c in ("logs", "score")], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("rare", "far", "syms")]])
    rows = materialize(docs.select("doc_id", "text").mapInArrow(run, kind).withColumn("rid", F.monotonically_increasing_id()), "scored")
    if whole:
        out = rows.withColumns({"k2": F.lit(0).cast("long"), "l2": F.lit(0.0)})
    else:
        rare = rows.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("tf")).join(counts.hint("merge"), "h")
        rare = rare.groupBy("rid").agg(F.sum("tf").alias("k2"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("l2"))
        out = rows.join(rare.hint("merge"), "rid", "left")
    if deep.whole:
        out = out.withColumn("s2", F.lit(0.0))
    else:
        far = rows.select("rid", F.explode(F.arrays_zip("far", "syms")).alias("x")).select("rid", F.col("x.far").alias("key"), F.col("x.syms").alias("sym"))
        far = far.groupBy("rid", "key", "sym").agg(F.count("*").alias("tf")).join(cold.select("key", "delta", "unseen").hint("merge"), "key")
        far = far.groupBy("rid").agg(F.sum(F.col("tf") * F.coalesce(F.try_element_at("delta", F.col("sym")), "unseen")).alias("s2"))
        out = out.join(far.hint("merge"), "rid", "left")
    n = F.col("n_tokens")
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("k2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") + F.coalesce("l2", F.lit(0.0)) - n * scale).alias("base_score"), (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"))
