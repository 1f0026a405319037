"""BPE encoding and decoding with a word lexicon compiled into a minimal acyclic transducer.

The frequent words of the corpus (counted by Spark over all texts) go, with their token ids, into an automaton whose
equal suffixes are shared; arcs carry word counts, so a walk yields the word's number and the number its ids. The
automaton is sent once to each executor, written to an unlinked temporary file and memory-mapped. A word that is not
in it is merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volley.llm.shared import give_back, materialize, small_batches, text_buffer, text_groups, top_counts

#: White space as the tokenizer's own pattern has it (Unicode White_Space).
_S = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
LEXICON_WORDS = 100_000
#: Bounds of a worker's memory: bytes of text taken at once; bytes of words and their ids that are kept for later texts.
_GROUP, _KNOWN = 1_000_000, 4_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """ids of the 256 bytes, ranks of pairs, bytes of every id, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = [0] * 256
        self.pieces: dict[int, bytes] = {i: s.encode() for s, i in self.special.items()}
        for token, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        self.pairs = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids, pairs = [self.byte_ids[b] for b in word], self.pairs
        if len(ids) > 48:
            return self._merge_long(ids)
        ranks = [pairs.get(p) for p in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for k, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = pairs.get((ids[at - 1], ids[at]))
            if at < len(ranks):
                ranks[at] = pairs.get((ids[at], ids[at + 1]))

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for words of any length."""
        n, pairs = len(ids), self.pairs
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r[0], k, a, b, r[1]) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (r := pairs.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
                if r := pairs.get((new, ids[after[j]])):
                    heapq.heappush(heap, (r[0], k, new, ids[after[j]], r[1]))
            if (p := before[k]) >= 0 and (r := pairs.get((ids[p], new))):
                heapq.heappush(heap, (r[0], p, ids[p], new, r[1]))
        return [x for x, live in zip(ids, alive) if live]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal automaton of the words as one block of bytes: sections after a table of their places.

    Words are added in order; the part of the last word that the next one doesn't share is frozen, each state being
    replaced by an equal one met before. Arc counts then number the words in sorted order.
    """
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    size: list[int] = []
    path: list[list] = [[False, []]]  # of states not frozen: (final, arcs), the last arc's target still open
    last = b""

    def freeze(state: list) -> int:
        key = (state[0], *state[1])
        if (k := register.get(key)) is None:
            k = register[key] = len(arcs)
            arcs.append(state[1])
            final.append(state[0])
            size.append(state[0] + sum(size[t] for _, t in state[1]))
        return k

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            k = freeze(path.pop())
            path[-1][1][-1] = (path[-1][1][-1][0], k)

    words = sorted(entries)
    for w in words:
        shared = next((i for i, (a, b) in enumerate(zip(w, last)) if a != b), min(len(w), len(last)))
        close(shared)
        for b in w[shared:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    root = freeze(path[0])
    first = np.zeros(len(arcs) + 1, np.int32)
    first[1:] = np.cumsum([len(a) for a in arcs])
    flat = [x for a in arcs for x in a]
    skip = []
    for s, a in enumerate(arcs):
        n = int(final[s])
        for _, t in a:
            skip.append(n)
            n += size[t]
    ids = [entries[w] for w in words]
    place = np.zeros(len(words) + 1, np.int32)
    place[1:] = np.cumsum([len(x) for x in ids])
    sections = {
        "first": first, "target": np.array([t for _, t in flat], np.int32), "skip": np.array(skip, np.int32), "place": place,
        "ids": np.array([i for x in ids for i in x], np.uint32), "final": np.array(final, np.uint8), "label": np.array([b for b, _ in flat], np.uint8), "root": np.array([root], np.int32),
    }
    places, blocks, at = {}, [], 0
    for name, a in sections.items():
        block = a.tobytes() + b"\0" * (-a.nbytes % 8)
        places[name] = (at, a.nbytes, a.dtype.char)
        blocks.append(block)
        at += len(block)
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(blocks)


class Lexicon:
    """The compiled automaton, memory-mapped from a file without a name; walked for many words at once."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self.map[:8], "little")
        part = {k: np.frombuffer(self.map, kind, size // np.dtype(kind).itemsize, 8 + n + a) for k, (a, size, kind) in json.loads(self.map[8 : 8 + n]).items()}
        self.target, self.skip, self.final, self.place, self.ids = (part[k] for k in ("target", "skip", "final", "place", "ids"))
        self.root = int(part["root"][0])
        state = np.repeat(np.arange(len(part["first"]) - 1), np.diff(part["first"]))
        self.arcs = state << 8 | part["label"]  # ascending: states in order, labels in order within a state

    def numbers(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word, given by its bytes' place and count in flat; -1 if it isn't in the lexicon."""
        state, number = np.full(len(start), self.root), np.zeros(len(start), np.int64)
        live, k = np.arange(len(start)), 0
        while True:
            on = live[size[live] > k]
            done = live[size[live] == k]
            number[done[self.final[state[done]] == 0]] = -1
            if not len(on):
                return number
            key = state[on] << 8 | flat[start[on] + k]
            arc = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(on), bool)
            number[on[~hit]] = -1
            live, arc = on[hit], arc[hit]
            number[live] += self.skip[arc]
            state[live] = self.target[arc]
            k += 1

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit numbers; None if it isn't in the lexicon."""
        n = int(self.numbers(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])
        return None if n < 0 else self.ids[self.place[n] : self.place[n + 1]].tobytes()


_NONE = 1 << 30


class Encoder:
    def __init__(self, vocab: Vocabulary, block: bytes):
        self.vocab, self.lexicon = vocab, Lexicon(block)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        top = max(vocab.pieces, default=-1) + 1
        pieces = [vocab.pieces.get(i, b"") for i in range(top)]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.byte_ids = np.array(vocab.byte_ids, np.int64)
        keys = np.array([a << 32 | b for a, b in vocab.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in vocab.pairs.values()], np.int64)[order]
        self.merged = np.zeros(int(self.ranks.max(initial=0)) + 1, np.int64)
        for r, new in vocab.pairs.values():
            self.merged[r] = new
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes in it

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge(self, ids: np.ndarray) -> list[bytes]:
        """Exact merges of words of one length, one merge of every word a turn: lowest rank first, leftmost of equals."""
        out: list[bytes] = [b""] * len(ids)
        row, rank = np.arange(len(ids)), self._rank(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), _NONE)
            for k, r in zip(np.flatnonzero(best == _NONE).tolist(), ids[best == _NONE].astype("<u4")):
                out[row[k]] = r.tobytes()
            on = best < _NONE
            if not on.any():
                return out
            row, ids, rank, at, best = row[on], ids[on], rank[on], at[on], best[on]
            n, m = np.arange(len(row)), ids.shape[1]
            take = np.arange(m - 1) + (np.arange(m - 1) > at[:, None])
            ids[n, at] = self.merged[best]
            ids = np.take_along_axis(ids, take, 1)
            if m == 2:
                rank = np.zeros((len(row), 0), np.int64)
                continue
            rank = np.take_along_axis(rank, np.arange(m - 2) + (np.arange(m - 2) >= at[:, None]), 1)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < m - 2)
            rank[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])

    def learn(self, words: list[str]) -> None:
        """Puts the ids of the words into `known`: from the lexicon, else by merging."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(raw), np.uint8)
        number = self.lexicon.numbers(flat, start, size)
        ids, place = self.lexicon.ids, self.lexicon.place.tolist()
        block = ids.tobytes()
        for k in np.flatnonzero(number >= 0).tolist():
            self.known[words[k]] = block[4 * place[number[k]] : 4 * place[number[k] + 1]]
        rest = np.flatnonzero(number < 0)
        for n in np.unique(size[rest]).tolist():
            these = rest[size[rest] == n]
            if n > 48:
                for k in these.tolist():
                    self.known[words[k]] = np.array(self.vocab.merge(raw[k]), "<u4").tobytes()
                continue
            for lo in range(0, len(these), 20_000):
                part = these[lo : lo + 20_000]
                for k, got in zip(part.tolist(), self._merge(self.byte_ids[flat[start[part][:, None] + np.arange(n)]])):
                    self.known[words[k]] = got

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit numbers; the new words of all texts are encoded together."""
        cut = []
        for text in texts:
            if self.special is None or not self.special.search(text):
                cut.append([(WORDS.findall(text), None)])
                continue
            parts, at = [], 0
            for m in self.special.finditer(text):
                parts.append((WORDS.findall(text[at : m.start()]), self.vocab.special[m[0]].to_bytes(4, "little")))
                at = m.end()
            cut.append([*parts, (WORDS.findall(text[at:]), None)])
        new = set()
        for parts in cut:
            for words, _ in parts:
                new.update(words)
        new.difference_update(self.known)
        self.learn(list(new))
        out = [b"".join([x for words, end in parts for x in (*map(self.known.__getitem__, words), end or b"")]) for parts in cut]
        self.held += sum(len(w) + len(self.known[w]) for w in new)
        if self.held > _KNOWN:
            self.known.clear()
            self.held = 0
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        i = np.frombuffer(ids, "<u4")
        n = self.length[i]
        take = np.repeat(self.start[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.bytes[take].tobytes().decode("utf-8", "replace")


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, words being what single spaces separate: counted by groups of texts, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = text_buffer(batch.column(0))[1]
            for a, b in text_groups(off, 8 * _GROUP):
                words = pc.split_pattern(batch.column(0).slice(a, b - a).drop_null(), " ").flatten()
                yield pa.RecordBatch.from_arrays(words.value_counts().flatten(), ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocab: Vocabulary, words: int = LEXICON_WORDS) -> bytes:
    """The automaton of the most frequent words of the corpus, each with a space before it, cut up as the tokenizer does.

    Those are the words of at least a count that at most `words` of them reach; only they reach the driver."""
    top = top_counts(materialize(count_words(docs), "words"), "n", words)
    cut = {w for r in top.select("word").toLocalIterator() for w in WORDS.findall(" " + r.word)}
    return compile_lexicon({w: vocab.merge(w) for w in map(str.encode, cut)})


def encode_documents(docs: DataFrame, vocab_path: str, words: int = LEXICON_WORDS, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, with_ids, the ids (array<int>) and, with_text, the decoded text.

    Null text counts as empty: no tokens, the digests of nothing. Special strings in a text become their special ids.
    Columns of these names in docs are replaced. Any text length; memory follows the longest text.
    """
    new = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    new |= {"ids": T.ArrayType(T.IntegerType())} if with_ids else {}
    new |= {"decoded": T.StringType()} if with_text else {}
    docs = docs.drop("ids", "decoded", *new)
    vocab = Vocabulary(vocab_path)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((vocab, build_lexicon(docs, vocab, words)))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(*sent.value)
        for batch in batches:
            off = text_buffer(batch.column(at))[1]
            for a, b in text_groups(off, _GROUP):
                part = batch.slice(a, b - a)
                column = part.column(at).fill_null("").dictionary_encode()  # equal texts of a group are encoded once
                n, ids_sha, text_sha, ids, texts = [], [], [], [], []
                for got in enc.encode_all(column.dictionary.to_pylist()):
                    back = enc.decode(got)
                    n.append(len(got) // 4)
                    ids_sha.append(hashlib.sha256(got).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        ids.append(got)
                    if with_text:
                        texts.append(back)
                arrays = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    ends = np.cumsum([0, *n]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                if with_text:
                    arrays.append(pa.array(texts, pa.string()))
                arrays = [x.take(column.indices) for x in arrays]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*names, *new])
                give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in new.items())]))
