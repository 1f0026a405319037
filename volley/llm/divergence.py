"""Source divergence audit: how far the sources of a language differ in their terms, and by which terms.

Partitions fold whole documents into stripes (term -> document frequency and count by source), which are spilled at a
bound and merged by key; the merged stripes give the divergences of all pairs of sources in one pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volley.llm.shared import LOWER_BYTES, join_small, materialize, small_batches, text_buffer, text_groups

#: Documents of a language that a term must be in; terms listed for a group.
MIN_DOCS, TOP = 10, 10
#: A probability is this times its value, rounded down, plus one.
UNIT = 1_000_000_000
#: Fixed table for bytes: A-Z lower-cased; what is no letter and not beyond ASCII becomes a blank.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in LOWER_BYTES.tolist())
#: Counts of (term, source) that a partition holds before it spills; cells of a matrix of pairs that a task holds.
SPILL, CELLS = 1_000_000, 4_000_000
#: Bytes of a text whose words are objects at a time.
PIECE = 4_000_000

_STRIPES = "lang string, term string, of array<struct<source: string, docs: long, n: long>>"
#: Bits of a key of a count that hold the number of its group (lang, source) in the partition; the others its term's.
_GROUP_BITS = 24


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, of a very long one by pieces that end at blanks."""
    plain, a = text.translate(_LETTERS), 0
    while a < len(plain):
        b = plain.find(b" ", a + PIECE)
        b = len(plain) if b < 0 else b
        yield plain[a:b].split()
        a = b


class Stripes:
    """What a partition has folded so far: terms and groups (lang, source) are numbered by hash tables; a stripe's entries
    are sorted keys (term, group) with documents and counts."""

    def __init__(self) -> None:
        self.terms: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.groups: defaultdict[tuple[str, str], int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def fold(self, texts: list[bytes], langs: list[str], sources: list[str]) -> None:
        """Adds whole documents. The term b'' stands for the document itself, with count 0."""
        ids = [np.fromiter((self.terms[b""],) * len(texts), np.int64, len(texts))]
        rows = [np.arange(len(texts))]
        for k, text in enumerate(texts):
            for words in _words(text):
                ids.append(np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)))
                rows.append(np.full(len(words), k))
        group = np.fromiter(map(self.groups.__getitem__, zip(langs, sources)), np.int64, len(texts))
        ids, rows = np.concatenate(ids), np.concatenate(rows)
        n = np.ones(len(ids), np.int64)
        n[: len(texts)] = 0
        pair = ids << 32 | rows  # at most 2^31 rows in a batch
        order = np.argsort(pair, kind="stable")
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        n = np.add.reduceat(n, first)
        key = pair[first] >> 32 << _GROUP_BITS | group[pair[first] & 0xFFFFFFFF]
        self.add(np.stack([key, np.ones(len(key), np.int64), n]))

    def add(self, part: np.ndarray) -> None:
        """A part's rows are keys, documents and counts; parts are summed when they have doubled the entries."""
        self.parts.append(part)
        if len(self.parts) == 1 or sum(p.shape[1] for p in self.parts) > max(2 * self.size, SPILL // 4):
            self.sum_up()

    def sum_up(self) -> np.ndarray:
        part = np.concatenate(self.parts, axis=1)
        part = part[:, np.argsort(part[0], kind="stable")]
        first = np.flatnonzero(np.diff(part[0], prepend=-1))
        part = np.concatenate([part[:1, first], np.add.reduceat(part[1:], first, axis=1)]) if len(first) else part
        self.parts, self.size = [part], part.shape[1]
        return part

    def batch(self) -> pa.RecordBatch:
        """The stripes by (lang, term), each with its sources."""
        key, docs, n = self.sum_up()
        names = list(self.groups)
        langs = {x: k for k, x in enumerate(sorted({l for l, _ in names}))}
        lang = np.array([langs[l] for l, _ in names])[key & (1 << _GROUP_BITS) - 1]
        term = key >> _GROUP_BITS
        order = np.lexsort((lang, term))
        key, docs, n, lang, term = key[order], docs[order], n[order], lang[order], term[order]
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))
        take = lambda values, kind, at: pa.array(values, kind).take(pa.array(at))
        source = take([s for _, s in names], pa.string(), key & (1 << _GROUP_BITS) - 1)
        entries = pa.StructArray.from_arrays([source, pa.array(docs), pa.array(n)], ["source", "docs", "n"])
        of = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), entries)
        words = take(list(self.terms), pa.binary(), term[first]).cast(pa.string())
        return pa.RecordBatch.from_arrays([take(list(langs), pa.string(), lang[first]), words, of], ["lang", "term", "of"])


def stripes(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """(lang, term, of): the stripes of all partitions; a term's stripes are yet to be merged. The term '' has the documents
    of each source in `docs`, so a group without terms has a stripe too. A partition spills its stripes when they have
    `spill` entries and starts anew."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes()
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in text_groups(off):
                held.fold([raw[x:y].tobytes() for x, y in zip(off[a:b].tolist(), off[a + 1 : b + 1].tolist())], langs[a:b], sources[a:b])
                if held.size >= spill or len(held.groups) >= 1 << _GROUP_BITS - 1:
                    yield held.batch()
                    held = Stripes()
        if held.parts:
            yield held.batch()

    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*text).mapInArrow(run, _STRIPES)


def merged(parts: DataFrame, least: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The whole stripes of the terms in at least `least` documents, (lang, term, of: (source, n)), and the groups (lang,
    source). Counts are summed by (lang, term, source), first inside the tasks, so a term of every document is not hot:
    each task has a row of it for each source. Both are written."""
    rows = parts.select("lang", "term", F.inline("of"))
    summed = rows.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    whole = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of"))  # one entry a source
    kept = materialize(whole.filter((F.col("term") == "") | (F.col("docs") >= least)).drop("docs"), "stripes")
    groups = kept.filter("term = ''").select("lang", F.explode("of.source").alias("source"))
    return kept.filter("term != ''"), groups


def totals(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, n, all, v): counts of kept terms in the group and in its language, and the language's kept terms."""
    flat = kept.select("lang", F.explode("of").alias("e"))
    by_group = flat.groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    by_lang = by_group.groupBy("lang").agg(F.sum("n").alias("all"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    rows = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").join(sizes, "lang", "left")
    return materialize(rows.na.fill(0, ["n", "all", "v"]), "groups")


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (n + 2 v)), in two steps that stay inside a long for counts below 2^46."""
    a, b, step = count + F.lit(2), n + F.lit(2) * v, 100_000
    high = F.call_function("div", a * step, b)
    return F.lit(1) + high * (UNIT // step) + F.call_function("div", (a * step - high * b) * (UNIT // step), b)


def _probability(count: np.ndarray, n: np.ndarray, v: np.ndarray) -> np.ndarray:
    a, b, step = count + 2, n + 2 * v, 100_000
    high = a * step // b
    return 1 + high * (UNIT // step) + (a * step - high * b) * (UNIT // step) // b


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def distinctive_terms(kept: DataFrame, sums: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` terms of each group that are likelier there than in its language. Spark ranks inside the tasks before
    it shuffles, so at most `top` rows a group and task move."""
    rows = kept.withColumn("total", F.expr("aggregate(of, 0L, (a, e) -> a + e.n)")).select("lang", "term", "total", F.explode("of").alias("e"))
    rows = join_small(rows.select("lang", F.col("e.source").alias("source"), "term", "total", F.col("e.n").alias("c")), sums, ["lang", "source"], "inner")
    rows = rows.withColumns({"p": probability(F.col("c"), F.col("n"), F.col("v")), "q": probability(F.col("total"), F.col("all"), F.col("v"))})
    rows = rows.filter((F.col("c") > 0) & (F.col("p") > F.col("q"))).withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _plan(sums: DataFrame, cells: int) -> list[dict[str, tuple[list[str], np.ndarray, np.ndarray, int, int, int]]]:
    """Passes over the stripes: lang -> (sources, their n, language's v, first and last source of the rows of the matrix).
    Each pass has at most `cells` cells (or one row); languages share a pass where they fit."""
    by: dict[str, list] = {}
    for r in sums.orderBy("lang", "source").toLocalIterator():
        by.setdefault(r["lang"], []).append(r)
    passes: list[dict] = [{}]
    room = cells
    for lang, rows in by.items():
        names, n, v = [r["source"] for r in rows], np.array([r["n"] for r in rows], np.int64), rows[0]["v"]
        a = 0
        while a < len(names):
            b = min(len(names), a + room // len(names))
            if b <= a or lang in passes[-1]:
                if passes[-1]:
                    passes.append({})
                    room = cells
                b = min(len(names), a + max(1, room // len(names)))
            passes[-1][lang] = (names, n, v, a, b)
            room -= (b - a) * len(names)
            a = b
    return passes


def pair_sums(kept: DataFrame, sums: DataFrame, cells: int = CELLS) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language, summed over all kept terms.

    A task folds its stripes into a matrix of sources x sources. A stripe's entry (term, source) gives its distance to all
    sources of the language, so the cost is that of entries x sources; terms in neither source of a pair add a constant,
    which is multiplied by their number at the end. Matrices of more than `cells` cells are made in several passes over
    the written stripes, so what a task holds and gets is bounded; the groups (a row each, fewer by far than the pairs
    that are returned) pass through the driver.
    """
    out = None
    for part in _plan(sums, cells):
        sent = kept.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = {lang: {s: k for k, s in enumerate(x[0])} for lang, x in sent.value.items()}
            made: dict[str, list[np.ndarray]] = {}
            for batch in batches:
                langs, of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for lang in sorted({x for x in langs if x in place}):
                    names, n, v, a, b = sent.value[lang]
                    rows = [r for x, r in zip(langs, of) if x == lang]
                    if lang not in made:
                        made[lang] = [np.zeros((b - a, len(names)), np.int64) for _ in range(2)]
                    for k in range(0, len(rows), max(1, CELLS // 8 // len(names))):
                        _fold(made[lang], rows[k : k + max(1, CELLS // 8 // len(names))], place[lang], n, v, a, b)
            for lang, (total, seen) in made.items():
                names, _, _, a, b = sent.value[lang]
                for k in range(b - a):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array([names[a + k]] * len(names)), pa.array(names), pa.array(total[k]), pa.array(seen[k])], ["lang", "source", "item", "value", "seen"])

        got = kept.select("lang", "of").mapInArrow(run, "lang string, source string, item string, value long, seen long")
        out = got if out is None else out.unionByName(got)
    found = out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    other = sums.select("lang", F.col("source").alias("item"), F.col("n").alias("m"))
    pairs = sums.join(other, "lang").filter("source != item").join(found, ["lang", "source", "item"], "left").na.fill(0, ["value", "seen"])
    nothing = F.lit(0).cast("long")
    pairs = pairs.withColumns({"p": F.when(F.col("v") > 0, probability(nothing, F.col("n"), F.col("v"))), "q": F.when(F.col("v") > 0, probability(nothing, F.col("m"), F.col("v")))})
    absent = F.coalesce(F.expr("(p - q) * (p - q) div (p + q)"), nothing)
    return pairs.select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("seen")) * absent).alias("value"))


def _fold(made: list[np.ndarray], rows: list[list[dict]], place: dict[str, int], n: np.ndarray, v: int, a: int, b: int) -> None:
    """Adds stripes to the matrices of values and of terms seen, whose rows are the sources a to b."""
    total, seen = made
    size = np.array([len(r) for r in rows])
    term = np.repeat(np.arange(len(rows)), size)
    source = np.array([place[e["source"]] for r in rows for e in r], np.int64)
    count = np.zeros((len(rows), len(n)), np.int64)
    count[term, source] = [e["n"] for r in rows for e in r]
    p = _probability(count, n, v)
    for g in range(a, b):
        t = term[source == g]  # terms of this source: against all sources
        total[g - a] += _apart(p[t, g][:, None], p[t]).sum(0)
        seen[g - a] += len(t)
        lacks = np.flatnonzero(count[:, g] == 0)  # terms it lacks: against the sources that have them
        has = count[lacks] > 0
        total[g - a] += np.where(has, _apart(p[lacks, g][:, None], p[lacks]), 0).sum(0)
        seen[g - a] += has.sum(0)


def audit(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP, spill: int = SPILL, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) of docs.

    Terms are runs of letters A-Z (lower-cased) and characters beyond ASCII; a language keeps those in at least `least` of
    its documents. Probabilities and distances are whole numbers, exact. Part `pair` has each other source of the
    language, part `term` the `top` terms that set the group apart. Null text, lang or source counts as ''. Ranks go by
    value, falling, then by item; repeated rows count as documents each. An empty table gives no row, a language whose
    terms are all rare gives pairs of value 0 and no terms, a source alone in its language no pair.
    """
    kept, groups = merged(stripes(docs, spill), least)
    sums = totals(kept, groups)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms, pairs = distinctive_terms(kept, sums, top), pair_sums(kept, sums, cells).withColumn("rank", F.row_number().over(w))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
