"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items scans every text once; what it
hits is given as words, items and spans of the original text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volley.llm.shared import LOWER_BYTES, ascii_lower, materialize, small_batches, text_buffer, text_groups, unused

WINDOW = 10
#: A word is a run of digits, letters A-Z (lower-cased) and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_IN_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Fixed table for bytes: A-Z lower-cased, what separates words becomes a blank.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER_BYTES.tolist())
#: Words of a block of an item, and words of items in one automaton (about 250 bytes each); beyond, there are several.
BLOCK_WORDS, AUTOMATON_WORDS = 1000, 400_000
#: Texts are cut into pieces of this many words (and a window less one), which are walked in step.
LANE = 512
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ADDED = [("n_words", T.LongType()), ("items", T.ArrayType(T.StringType())), ("spans", SPANS), ("n_hit", T.LongType())]


class Automaton:
    """Aho-Corasick over words. Nodes are numbered by depth; arrays hold the edges (sorted by parent and word), the
    failure links, the next accepting node on the chain of failures and the items of each accepting node."""

    def __init__(self, patterns: list[tuple[list[str], int]], items: list[str]):
        """patterns: (words, number of the item)."""
        self.items = items
        self.words: dict[bytes, int] = {}
        number = self.words.setdefault
        of = np.array([i for _, i in patterns], np.int64)
        size = np.array([len(p) for p, _ in patterns], np.int64)
        width = int(size.max(initial=0))
        grid = np.zeros((len(patterns), width), np.int64)
        for k, (p, _) in enumerate(patterns):
            grid[k, : len(p)] = [number(w.encode(), len(self.words) + 1) for w in p]  # word 0 is any other word
        self.base = len(self.words) + 1
        at, first, keys, n = np.zeros(len(patterns), np.int64), [1], [], 1
        for d in range(width):
            live = np.flatnonzero(size > d)
            k, node = np.unique(at[live] * self.base + grid[live, d], return_inverse=True)
            at[live] = n + node
            keys.append(k)
            n += len(k)
            first.append(n)
        # parents of a depth precede those of the next and children are numbered in the order of keys: node = place + 1
        self.keys = np.concatenate([*keys, np.zeros(0, np.int64)])
        self.depth = np.zeros(n, np.int64)
        for d in range(width):
            self.depth[first[d] : first[d + 1]] = d + 1
        order = np.lexsort((of, at))
        pair = np.stack([at, of])[:, order]
        pair = pair[:, np.any(np.diff(pair, prepend=-1) != 0, 0)]
        self.of, self.start = pair[1], np.searchsorted(pair[0], np.arange(n + 1))
        self.fail = np.zeros(n, np.int64)
        self.accept = np.zeros(n, np.int64)  # the node itself or the next below that accepts, 0 if none
        ends = np.diff(self.start) > 0
        for d in range(width):
            node = np.arange(first[d], first[d + 1])
            if d:
                self.fail[node] = self.step(self.fail[self.keys[node - 1] // self.base], self.keys[node - 1] % self.base)
            self.accept[node] = np.where(ends[node], node, self.accept[self.fail[node]])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after reading one word each."""
        state, out = state.copy(), np.zeros(len(state), np.int64)
        live = np.flatnonzero(word > 0)
        while len(live):
            key = state[live] * self.base + word[live]
            place = np.searchsorted(self.keys, key)
            found = self.keys[np.minimum(place, len(self.keys) - 1)] == key
            out[live[found]] = place[found] + 1
            live = live[~found & (state[live] > 0)]
            state[live] = self.fail[state[live]]
        return out

    def scan(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, accepting node) of every occurrence in a stream of word numbers."""
        reach = int(self.depth.max(initial=1)) - 1
        lanes = -(-len(words) // LANE)
        padded = np.zeros(lanes * LANE + reach, np.int64)
        padded[reach : reach + len(words)] = words
        state, places, nodes = np.zeros(lanes, np.int64), [], []
        begin = np.arange(lanes) * LANE
        for k in range(LANE + reach):  # a lane first reads the words before its own
            state = self.step(state, padded[begin + k])
            if k >= reach:
                live = np.flatnonzero(self.accept[state])
                node = self.accept[state[live]]
                while len(live):
                    places.append(begin[live] + k - reach)
                    nodes.append(node)
                    node = self.accept[self.fail[node]]
                    live, node = live[node > 0], node[node > 0]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(places or none), np.concatenate(nodes or none)

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, whether each word is hit, text of a pair, item of a pair) for texts with blanks between words."""
        get, ids = self.words.get, []
        size = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            for piece in _pieces(t):
                w = piece.split()
                size[k] += len(w)
                ids.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            ids.append(np.zeros(1, np.int64))  # no window runs from text to text
        words = np.concatenate(ids)
        after = np.cumsum(size + 1)
        last, node = self.scan(words)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, last + 1 - self.depth[node], 1)
        np.add.at(change, last + 1, -1)
        text = np.searchsorted(after, last, "right")
        text, node = np.unique(np.stack([text, node]), axis=1)
        many = self.start[node + 1] - self.start[node]
        place = np.repeat(self.start[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pair = np.unique(np.stack([np.repeat(text, many), self.of[place]]), axis=1)
        return size, np.cumsum(change[:-1]) > 0, pair[0], pair[1]


def _pieces(text: bytes, most: int = 4_000_000) -> Iterator[bytes]:
    """A text in pieces that end at blanks, so that the words of a very long one are not objects all at once."""
    a = 0
    while a < len(text):
        b = text.find(b" ", a + most)
        b = len(text) if b < 0 else b
        yield text[a:b]
        a = b


def windows(words: list[str], width: int) -> list[list[str]]:
    return [words[k : k + width] for k in range(max(1, len(words) - width + 1))] if words else []


def item_blocks(items: DataFrame, id_col: str, window: int) -> DataFrame:
    """(item, words): the words of each item in blocks that overlap by a window less one, so that a long item is many rows."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("all")).filter(F.size("all") > 0)
    last = F.greatest(F.size("all") - window, F.lit(0))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), last, F.lit(BLOCK_WORDS))))
    return rows.select("item", F.slice("all", F.col("at") + 1, F.lit(BLOCK_WORDS + window - 1)).alias("words"))


def automaton_of(blocks: DataFrame, part: int, parts: int, window: int) -> Automaton:
    """The automaton over the windows of the blocks that a hash deals to a part; only these reach the driver."""
    rows = blocks.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part).collect()
    names = sorted({r["item"] for r in rows})
    number = {x: k for k, x in enumerate(names)}
    return Automaton([(w, number[r["item"]]) for r in rows for w in windows(r["words"], window)], names)


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the original text."""
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    firsts, lasts, out, start = set(edges[::2].tolist()), set((edges[1::2] - 1).tolist()), [], 0
    for k, m in enumerate(_WORD_IN_TEXT.finditer(text)):
        if k in firsts:
            start = m.start()
        if k in lasts:
            out.append({"start": start, "end": m.end()})
    return out


def _join(text: str, old: list[dict], new: list[dict]) -> list[dict]:
    """The union of two lists of runs; runs with no word between them become one."""
    out: list[dict] = []
    for s in sorted([*old, *new], key=lambda s: s["start"]):
        if out and (s["start"] <= out[-1]["end"] or not _WORD_IN_TEXT.search(text, out[-1]["end"], s["start"])):
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _words_within(text: str, spans: list[dict]) -> int:
    return sum(1 for s in spans for _ in _WORD_IN_TEXT.finditer(text, s["start"], s["end"]))


def scan(docs: DataFrame, automaton: Automaton, again: bool, with_text: bool = True) -> DataFrame:
    """docs with ADDED columns; `again`: docs has them from another automaton, and gets the union."""
    small_batches(docs.sparkSession)
    at, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(automaton)
    kept = [f for f in docs.schema.fields if (with_text or f.name != "text") and f.name not in dict(ADDED)]
    places = [docs.columns.index(f.name) for f in kept]
    old_items, old_spans = (docs.columns.index(n) if again else None for n in ("items", "spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(at))
            for a, b in text_groups(off):
                texts = [raw[x:y].tobytes() for x, y in zip(off[a:b].tolist(), off[a + 1 : b + 1].tolist())]
                size, hit, of, item = sent.value.hits([t.translate(_PLAIN) for t in texts])
                items, spans, n_hit = [[] for _ in texts], [[] for _ in texts], np.zeros(len(texts), np.int64)
                begin = np.cumsum(size + 1) - size - 1
                for t, i in zip(of.tolist(), item.tolist()):
                    items[t].append(sent.value.items[i])  # items are numbered in the order of their names
                for t in np.unique(of).tolist():
                    mine = hit[begin[t] : begin[t] + size[t]]
                    spans[t], n_hit[t] = _spans(texts[t].decode("utf-8", "replace"), mine), int(mine.sum())
                if again:
                    before = zip(batch.column(old_items).slice(a, b - a).to_pylist(), batch.column(old_spans).slice(a, b - a).to_pylist())
                    for t, (i, s) in enumerate(before):
                        if s:
                            text = texts[t].decode("utf-8", "replace")
                            items[t], spans[t] = sorted({*items[t], *i}), _join(text, s, spans[t])
                            n_hit[t] = _words_within(text, spans[t])
                new = [pa.array(size), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(n_hit)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in places), *new], [*(f.name for f in kept), *dict(ADDED)])

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(*x) for x in ADDED)]))


def find_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "item_id", window: int = WINDOW, most: int = AUTOMATON_WORDS, with_text: bool = True) -> DataFrame:
    """docs with n_words, n_hit, items (ids as text, sorted as text) and spans (runs of hit words in code points of the
    original text, end exclusive) added; columns of those names are replaced.

    A window is `window` words on end of an item, or all words of an item that has fewer; items without words have none. A
    word of a text is hit inside any occurrence of a window. Null texts count as empty and have no words; repeated rows
    of docs stay rows each; items of one id count as one item, one without an id as the item ''; without items nothing
    is hit. Rows are neither shuffled nor gathered: an automaton is broadcast (its size is bounded by `most` words,
    counted before) and texts of any length are walked in pieces of LANE words. Items beyond `most` words give several
    automata; then the texts are scanned once for each and written in between.
    """
    docs = docs.drop(*dict(ADDED))
    blocks = materialize(item_blocks(items, id_col, window).distinct(), "items")
    n = int(blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0])
    parts = max(1, -(-n // most))
    for p in range(parts):
        docs = scan(materialize(docs, "scanned") if p else docs, automaton_of(blocks, p, parts, window), p > 0, with_text or p < parts - 1)
    return docs


def without_spans(text: Column, spans: Column) -> Column:
    """text without its spans, each of which leaves a blank: for corpora that drop the passage and keep the document."""
    cut = F.aggregate(spans, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), lambda a, s: F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(" ")).alias("done"), s["end"].alias("at")))
    return F.when(F.size(spans) > 0, F.concat(cut["done"], F.substring(text, cut["at"] + 1, F.length(text)))).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id with the counts and the digest of the items."""
    (joined,) = unused(found, "joined")
    return found.withColumn(joined, F.array_join("items", ",")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.col(joined).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
