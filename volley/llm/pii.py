"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Four exact patterns give the seed spans of a text. The seeds make lexical patterns: the two words before a token, the
word before and the word after a run of tokens, and what seeds look like (their shape, the end of a dotted name).
Whatever stands in the slot of a pattern of seeds or looks like them, is an instance; the graph of patterns and
instances is scored in turns, and instances met in high-confidence patterns are added as spans. Offsets are code points,
ends exclusive.

Patterns are read from a text in which each seed is one marked word. All steps are linear in a text: sums along an
array are taken by doubling, sums along a text by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volley.llm.shared import join_small, materialize

#: Fixed patterns, leftmost and non-overlapping within a kind. The possessive ++ and the look-behinds don't change
#: what matches, they only keep the search linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPACE, SPACES = r"[\x20\x09-\x0D]", " \t\n\x0b\f\r"
#: A seed in the text that patterns are read from: mark, kind, hash of the seed, its length, mark.
MARK = "\ue000"
ANY = "(?:" + ")|(?:".join(PATTERNS[k] for k in ("phone", "email", "ip", "card")) + ")"
#: A pattern needs so many different seeds; its share of seeds among all it is met with must not be below MIN_SHARE for
#: certain (by the upper end of its 95 % interval). Neither depends on the size of the corpus.
ROUNDS, MIN_SEEDS, MIN_SHARE, MIN_CONFIDENCE = 3, 3, 0.25, 0.8
#: Tokens at most between the two words of a slot; characters of a word that count in a pattern; the longest token with
#: a shape (as long as an address of mail can be).
RUN, WORD, LOOK = 8, 32, 254
#: The share of texts, one in PART, in which patterns are counted first. It spares work and changes no result.
PART = 64
#: Patterns (a number each) up to which they are sent to all tasks.
LARGE = 1_000_000
#: Punctuation that doesn't belong to what stands in a slot, before and after it.
LEAD, TRAIL = "\"'([<{", "\"')]>}.,;:!?"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, less 9 above 9; the sum must be a multiple of 10."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _running(sizes: Column, n: Column) -> Column:
    """Sums of the elements before each of the n elements of an array, in log2(n) steps of adding a shifted copy."""
    steps = F.slice(F.sequence(F.lit(0), F.lit(31)), F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))
    zeros = lambda k: F.array_repeat(F.lit(0), F.pow(F.lit(2), k).cast("int"))
    whole = F.aggregate(steps, sizes, lambda a, k: F.slice(F.zip_with(a, F.concat(zeros(k), a), lambda x, y: F.coalesce(x, F.lit(0)) + y), F.lit(1), F.greatest(n, F.lit(1))))
    return F.zip_with(whole, sizes, lambda x, y: x - y)


def _pieces(text: Column, pattern: str) -> Column:
    """Array of (gap, hit): the matches and the text between the one before and each."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))


def _gate(text: Column, kind: str) -> Column:
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


SPANS = "array<struct<start:int,end:int,hit:string>>"


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with a column for each kind: an array of (start, end, hit); matches that fail the kind's test are dropped."""
    out = docs.withColumns({k: F.when(_gate(F.col(text), k), _pieces(F.col(text), PATTERNS[k])) for k in KINDS})
    for k in KINDS:
        sizes = F.transform(k, lambda x: x["gap"] + F.length(x["hit"]))
        starts = F.zip_with(_running(sizes, F.size(k)), k, lambda s, x: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + F.length(x["hit"])).alias("end"), x["hit"].alias("hit")))
        out = out.withColumn(k, F.when(F.size(k) > 0, F.filter(starts, lambda x: _valid(k, x["hit"]))).otherwise(F.array().cast(SPANS)))  # noqa: B023
    return out


def _marked(text: str) -> Column:
    """The text with each seed as one marked word."""
    hits = F.regexp_extract_all(text, F.lit(ANY), 0)
    kind = lambda h: F.when(h.contains("@"), 0).when(h.startswith("+"), F.when(_valid("phone", h), 3)).when(_valid("ip", h), 1).when(_valid("card", h), 2)
    sign = lambda h: F.concat(F.lit(MARK), kind(h).cast("string"), F.hex(F.xxhash64(F.lower(h))), F.lit(":"), F.length(h).cast("string"), F.lit(MARK))
    parts = F.split(text, ANY, -1)
    return F.concat(F.array_join(F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), hits, lambda gap, h: F.concat(gap, F.coalesce(sign(h), h))), ""), F.element_at(parts, -1))


def _words(rows: DataFrame) -> DataFrame:
    """rows with w: the lower-cased words of `masked` after two ^ and before a $."""
    words = F.split(F.btrim(F.lower("masked"), F.lit(SPACES)), SPACE + "+")
    return rows.filter("masked <> ''").withColumn("w", F.concat(F.array(F.lit("^"), F.lit("^")), words, F.array(F.lit("$"))))


def _places(rows: DataFrame, width: int, *more: str) -> DataFrame:
    """A row for every word of a text: its number `at`, and w0, w1 (the two before it), w2 (itself) and those after it,
    `width` in all, null beyond the end. The arrays are shifted, not cut out for each word, so this is linear."""
    shifted = [F.when(F.size("w") > k, F.slice("w", k + 1, F.size("w") - k)).otherwise(F.array().cast("array<string>")).alias(f"w{k}") for k in range(width)]
    out = _words(rows).select(*more, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "x"))
    return out.select(*more, (F.col("pos") + 2).alias("at"), *[F.col(f"x.w{k}") for k in range(width)]).filter("w3 is not null")


def _left(one: Column) -> Column:
    return F.xxhash64(F.lit("L"), F.left(one, F.lit(WORD)))


def _pair(kind: str, a: Column, b: Column) -> Column:
    """A pattern, known by a 64-bit hash of its form and words."""
    return F.xxhash64(F.lit(kind), F.left(a, F.lit(WORD)), F.left(b, F.lit(WORD)))


def _shapes(rows: DataFrame, run: str) -> DataFrame:
    """rows with exploded `pattern`s of what the token or run of tokens `run` looks like: its shape (digits as 9, letters
    as one a, what is between as . or -), the shape with each number as one 9, and the last two labels of a dotted name
    with something before it. Each step is a projection of its own, as Spark would not compile them in one."""
    out = rows.withColumn("_short", F.when(F.length(run) <= LOOK, F.lower(run)))
    out = out.withColumn("_shape", F.regexp_replace(F.regexp_replace("_short", "^[^\\p{L}0-9]+|[^\\p{L}0-9]+$", ""), "[0-9]", "9"))
    out = out.withColumn("_shape", F.regexp_replace(F.regexp_replace("_shape", "[^\\p{L}9.]*+\\.[^\\p{L}9]*", "."), "[^\\p{L}9.]+", "-"))
    out = out.withColumn("_shape", F.regexp_replace("_shape", "\\p{L}+", "a"))
    out = out.withColumn("_coarse", F.when(F.col("_shape").rlike("9[.-]"), F.regexp_replace("_shape", "9+", "9")))
    out = out.withColumn("_tail", F.regexp_extract("_short", "[^\\p{L}0-9-]([\\p{L}0-9-]+\\.\\p{L}+)$", 1))
    form = lambda name, x, ok: F.when(ok, F.xxhash64(F.lit(name), x))
    forms = [form("E", F.col("_shape"), F.col("_shape").rlike("[9.-]")), form("C", F.col("_coarse"), F.col("_coarse").isNotNull()), form("T", F.col("_tail"), F.col("_tail") != "")]
    return out.select(*rows.columns, F.explode(F.array(*forms)).alias("pattern")).filter("pattern is not null")


def _numeric(word: Column) -> Column:
    return word.rlike("[0-9]") & ~word.rlike("\\p{L}") & ~word.contains(MARK)


def _looks(rows: DataFrame, *more: str) -> DataFrame:
    """(more, at, n, run, pattern): the shapes of every word with more than letters in it, and of it with the next one or
    two where all are numbers."""
    places = _places(rows, 5, *more).filter(F.col("w2").rlike("[^\\p{L}]") & ~F.col("w2").contains(MARK))
    places = places.select("*", *[_numeric(F.col(f"w{k}")).alias(f"is{k}") for k in (2, 3, 4)])
    runs = F.array(F.col("w2"), F.when(F.col("is2") & F.col("is3"), F.concat_ws(" ", "w2", "w3")), F.when(F.col("is2") & F.col("is3") & F.col("is4"), F.concat_ws(" ", "w2", "w3", "w4")))
    out = places.select(*more, "at", F.posexplode(runs).alias("n", "run")).filter("run is not null").withColumns({"n": F.col("n") + 1, "run": _trim(F.col("run"))})
    return _shapes(out.filter(F.col("run").rlike("[^\\p{L}]")), "run")


def _trim(text: Column) -> Column:
    return F.rtrim(F.ltrim(text, F.lit(LEAD)), F.lit(TRAIL))


def _seed_patterns(rows: DataFrame) -> DataFrame:
    """(pattern, form, one, hit, kind): the words around every marked word that is a seed and nothing else but
    punctuation around it (form `words`), and the shapes of every seed, of phone numbers also without the first group
    (form `looks`)."""
    at = F.filter(F.transform("w", lambda x, i: F.when(x.contains(MARK), i).otherwise(-1)), lambda i: i >= 0)
    some = _words(rows.filter(F.col("masked").contains(MARK))).select(F.explode(F.transform(at, lambda i: F.slice("w", i - 1, F.lit(4)))).alias("w"))
    two, one, seed, after = (F.get("w", F.lit(k)) for k in range(4))
    sign = F.regexp_extract(_trim(seed), f"^{MARK}([0-3][0-9a-f]+):[0-9]+{MARK}$", 1)
    some = some.select(sign.alias("sign"), _left(one).alias("one"), F.array(_pair("LL", two, one), _pair("LR", one, after)).alias("patterns")).filter("sign <> ''")
    some = some.select(F.explode("patterns").alias("pattern"), F.lit("words").alias("form"), "one", F.xxhash64("sign").alias("hit"), F.get(F.array(*map(F.lit, KINDS)), F.left("sign", F.lit(1)).cast("int")).alias("kind"))
    of_kind = lambda n: F.transform(KINDS[n], lambda x: F.struct(F.lit(n).alias("k"), x["hit"].alias("hit")))
    each = F.concat(*map(of_kind, range(len(KINDS))))
    looks = rows.select(F.explode(each).alias("x")).select("x.*")
    rest = F.when(F.col("k") == KINDS.index("phone"), F.regexp_replace("hit", "^\\+[0-9]+[^0-9]+", ""))
    looks = _shapes(looks.select("k", "hit", F.explode(F.array_distinct(F.array("hit", rest))).alias("run")).filter("run is not null"), "run")
    sign = F.lower(F.concat(F.col("k").cast("string"), F.hex(F.xxhash64(F.lower("hit")))))
    looks = looks.select("pattern", F.lit("looks").alias("form"), F.lit(None).cast("bigint").alias("one"), F.xxhash64(sign).alias("hit"), F.get(F.array(*map(F.lit, KINDS)), F.col("k")).alias("kind"))
    return some.unionByName(looks)


def _met(rows: DataFrame, able: DataFrame) -> DataFrame:
    """(pattern, met): how often each pattern of able has one word that is no seed in its slot (or a look). Only sums by
    pattern are shuffled; beyond LARGE patterns all pairs of words are summed before the join."""
    w = [F.col(f"w{k}") for k in range(4)]
    around = F.array(_pair("LL", w[0], w[1]), _pair("LR", w[1], w[3]))
    every = _places(rows, 4).filter(~F.col("w2").contains(MARK)).select(F.explode(around).alias("pattern")).unionByName(_looks(rows).select("pattern"))
    if able.limit(LARGE + 1).count() <= LARGE:
        return every.join(F.broadcast(able.select("pattern")), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("met"))
    return every.groupBy("pattern").agg(F.count("*").alias("met")).join(able.select("pattern").hint("merge"), "pattern", "left_semi")


def _slots(rows: DataFrame, able: DataFrame) -> DataFrame:
    """(doc_id, key, at, n, pattern, hit, open): what stands in the slots of patterns (pattern, form, one): n words from
    number `at` on. A slot after two words is one word, a slot between two words all words up to the next such word, a
    look is a word or a run of numbers. `open` is false for a plain word (letters only) and for what one of the exact
    patterns matches (its test failed, else it were a seed): these count against a pattern but are never added. What
    holds a seed is left out."""
    w = [F.col(f"w{k}") for k in range(RUN + 3)]
    run = lambda n: F.when(n == 1, w[2]).otherwise(F.array_join(F.slice(F.array(*w[2:]), F.lit(1), n), " "))
    words, looks = (materialize(able.filter(F.col("form") == f).select("pattern", "one"), f) for f in ("words", "looks"))
    parts = []
    if not words.isEmpty():
        near = _places(rows, RUN + 3, "doc_id", "key").withColumn("one", _left(w[1]))
        near = join_small(near, materialize(words.select("one").distinct(), "lefts"), "one", "left_semi", LARGE)
        two = F.struct(F.lit(1).alias("n"), _pair("LL", w[0], w[1]).alias("pattern"))
        between = [F.struct(F.lit(n).alias("n"), F.when(F.lit(True) if n == 1 else ~_in(w[n + 2], w[3 : n + 2]), _pair("LR", w[1], w[n + 2])).alias("pattern")) for n in range(1, RUN + 1)]
        near = near.withColumn("c", F.explode(F.array(two, *between))).filter("c.pattern is not null").filter(w[2].isNotNull())
        near = near.filter(F.get(F.array(*w[2:]), F.col("c.n")).isNotNull())
        parts.append(near.select("doc_id", "key", "at", "c.n", "c.pattern", run(F.col("c.n")).alias("run")).transform(lambda x: join_small(x, words.select("pattern"), "pattern", "left_semi", LARGE)))
    if not looks.isEmpty():
        parts.append(join_small(_looks(rows, "doc_id", "key"), looks.select("pattern"), "pattern", "left_semi", LARGE).select("doc_id", "key", "at", "n", "pattern", "run"))
    if not parts:
        return rows.select("doc_id", "key", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("pattern"), F.lit(0).cast("bigint").alias("hit"), F.lit(False).alias("open")).limit(0)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.withColumn("run", _trim(F.col("run"))).filter(~F.col("run").contains(MARK) & (F.col("run") != ""))
    return out.select("doc_id", "key", "at", "n", "pattern", F.xxhash64("run").alias("hit"), (F.col("run").rlike(r"[^\p{L}]") & ~F.col("run").rlike(f"^(?:{ANY})$")).alias("open"))


def _in(word: Column, words: list[Column]) -> Column:
    """Whether the word, as far as it counts in a pattern, is one of these."""
    return F.array_contains(F.array(*[F.left(x, F.lit(WORD)) for x in words]), F.left(word, F.lit(WORD)))


def _upper(good: Column, n: Column) -> Column:
    """The upper end of Wilson's 95 % interval of a share of good in n."""
    z, p = 1.96, good / n
    return (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found (doc_id, key, at, n, kind, confidence) with start and end in place of at and n, from the masked texts of
    rows. A window along each text that has something to place counts its characters."""
    need = materialize(found.select("key").distinct(), "need")
    texts = join_small(rows.select("key", "masked"), need, "key", "left_semi").dropDuplicates(["key"])
    pieces = texts.select("key", F.posexplode(F.split("masked", SPACE, -1)).alias("pos", "x"))
    lengths = F.aggregate(F.regexp_extract_all("x", F.lit(f":([0-9]+){MARK}"), 1), F.lit(0), lambda a, m: a + m.cast("int"))
    size = F.length(F.regexp_replace("x", f"{MARK}[0-3][0-9A-F]+:[0-9]+{MARK}", "")) + lengths
    along = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("size", F.when(F.col("x").contains(MARK), size).otherwise(F.length("x")))
    pieces = pieces.select("key", "x", F.sum(F.when(F.col("x") != "", 1)).over(along).alias("word"), (F.sum(F.col("size") + 1).over(along) - 1).alias("end"), "size").filter("x <> ''")
    ends = found.select("key", F.explode(F.array(F.col("at"), F.col("at") + F.col("n") - 1)).alias("number")).distinct().withColumn("word", F.col("number").cast("long") - 1)
    pieces = materialize(pieces.join(ends.hint("merge"), ["key", "word"]), "ends")  # word 1 is number 2
    lead = F.length("x") - F.length(F.ltrim("x", F.lit(LEAD)))
    first = pieces.select("key", F.col("number").alias("at"), (F.col("end") - F.col("size") + lead).cast("int").alias("start"))
    trail = F.length("x") - F.length(F.rtrim("x", F.lit(TRAIL)))
    last = pieces.select("key", F.col("number").alias("to"), (F.col("end") - trail).cast("int").alias("end"))
    out = found.withColumn("to", F.col("at") + F.col("n") - 1).join(first.hint("merge"), ["key", "at"]).join(last.hint("merge"), ["key", "to"])
    return out.select("doc_id", "key", "kind", "confidence", "start", "end")


def _apart(base: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, key, start, end, k) of found without what overlaps a base span; of a chain of overlapping spans the
    longest stays (of equal ones the first). Windows along a text, nothing is compared pair by pair."""
    both = found.withColumn("based", F.lit(False)).unionByName(base.withColumns({"k": F.lit(-1), "based": F.lit(True)}).select(*found.columns, "based"))
    before = Window.partitionBy("doc_id", "key").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("doc_id", "key").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"was": F.max(F.when(F.col("based"), F.col("end"))).over(before), "next": F.min(F.when(F.col("based"), F.col("start"))).over(after)})
    free = both.filter("not based and coalesce(was <= start, true) and coalesce(next >= end, true)")
    order = Window.partitionBy("doc_id", "key").orderBy("start", "end", "k")
    free = free.withColumn("new", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True)))
    free = free.withColumn("chain", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return free.groupBy("doc_id", "key", "chain").agg(F.max_by(F.struct("start", "end", "k"), F.struct(F.col("end") - F.col("start"), -F.col("start"), -F.col("k"))).alias("x")).select("doc_id", "key", "x.*")


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added) for each row of docs.

    Null text counts as empty: no spans, the digest of nothing. `spans` holds base and added spans as
    kind:start:end by kind, then start; `added` is the number of added ones. Rows that are repeated, and null ids, are
    treated like any other; other columns of docs are not looked at.

    Patterns with fewer than MIN_SEEDS different seeds, or certainly less than a MIN_SHARE of seeds among all they are met
    with, are left out of the graph. What an exact pattern matches but its test rejects counts against a pattern and is
    never added. A pattern's confidence for a kind is the sum of its instances' scores over
    their number + 1; a seed scores 1 (for the kind that comes last in the alphabet, should it have several), another
    instance the highest confidence of its patterns, counted as 1 from MIN_CONFIDENCE on. After ROUNDS turns, instances
    in patterns of at least MIN_CONFIDENCE that overlap no base span are added, with the kind of highest confidence (of
    equal ones, the alphabet's last); of a chain of overlapping ones the longest stays. Single words of letters only are
    never added.
    """
    rows = base_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    rows = rows.withColumn("clean", F.when(F.col("text").contains(MARK), F.translate("text", MARK, "\ue001")).otherwise(F.col("text")))
    some = sum((F.size(k) for k in KINDS[1:]), F.size(KINDS[0])) > 0
    rows = materialize(rows.select("doc_id", F.xxhash64("text").alias("key"), *KINDS, F.when(some, _marked("clean")).otherwise(F.col("clean")).alias("masked")), "spans")
    seeds = _seed_patterns(rows).groupBy("pattern", "form", "one", "hit").agg(F.max("kind").alias("kind"), F.count("*").alias("times"))
    seeds = materialize(seeds, "seeds")
    able = seeds.groupBy("pattern", "form", "one").agg(F.count("*").alias("seeds"), F.sum("times").alias("times")).filter(F.col("seeds") >= MIN_SEEDS)
    able = materialize(able, "able")
    plain = rows.select("doc_id", "key", "masked")
    if not able.isEmpty():
        # what is met in a part of the texts is a lower bound of what is met in all: patterns that fail on it fail anyway
        for part in (plain.filter(F.pmod("key", F.lit(PART)) == 0), plain):
            met = materialize(_met(part, able), "met").hint("merge")
            n = F.col("times") + F.coalesce("met", F.lit(0))
            able = materialize(able.join(met, "pattern", "left").filter(_upper(F.col("times"), n) >= MIN_SHARE).select(*able.columns), "able")
    slots = materialize(_slots(plain, able), "slots")

    seeds = seeds.join(able.select("pattern").hint("merge"), "pattern", "left_semi")
    edges = slots.groupBy("pattern", "hit").agg(F.max("open").alias("open")).withColumn("kind", F.lit(None).cast("string"))
    edges = edges.unionByName(seeds.select("pattern", "hit", "kind").withColumn("open", F.lit(True)))
    edges = materialize(edges.groupBy("pattern", "hit").agg(F.max("kind").alias("kind"), F.max("open").alias("open")), "edges")
    number = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    edges = materialize(edges.join(number.hint("merge"), "pattern"), "graph")
    known = edges.filter("kind is not null").groupBy("hit", "kind").agg(F.lit(1.0).alias("score"))
    scores = materialize(known, "scores")
    confident = None
    for turn in range(ROUNDS):
        sums = edges.select("pattern", "n", "hit").join(scores.hint("merge"), "hit").groupBy("pattern", "n", "kind").agg(F.sum("score").alias("s"))
        confident = materialize(sums.select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("confidence")), "confidence")
        if turn == ROUNDS - 1:
            break
        others = edges.filter("kind is null and open").select("pattern", "hit").join(confident.hint("merge"), "pattern").groupBy("hit", "kind").agg(F.max("confidence").alias("c"))
        others = others.select("hit", "kind", F.when(F.col("c") >= MIN_CONFIDENCE, 1.0).otherwise(F.col("c")).alias("score"))
        scores = materialize(known.unionByName(others).groupBy("hit", "kind").agg(F.max("score").alias("score")), "scores")
    sure = materialize(confident.filter(F.col("confidence") >= MIN_CONFIDENCE), "sure")
    found = materialize(join_small(slots.filter("open").drop("hit", "open"), sure, "pattern", "inner").drop("pattern"), "found")
    placed = _placed(rows, found).groupBy("doc_id", "key", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    placed = materialize(placed.select("doc_id", "key", "start", "end", rank[F.col("kind")].alias("k")), "placed")
    near = join_small(rows.select("doc_id", "key", *KINDS), materialize(placed.select("key").distinct(), "with-more"), "key", "left_semi")
    base = near.select("doc_id", "key", F.explode(F.concat(*KINDS)).alias("x")).select("doc_id", "key", "x.start", "x.end").distinct()
    added = _apart(base, placed).groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("k", "start", "end"))).alias("more"))  # of one text
    added = materialize(added, "added").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "more")
    out = rows.drop("masked").join(added.hint("merge"), rows["doc_id"].eqNullSafe(added["_id"]) & (rows["key"] == added["_key"]), "left")

    def numbered(k: int) -> Column:
        return F.transform(KINDS[k], lambda x: F.struct(F.lit(k).alias("k"), x["start"].alias("start"), x["end"].alias("end")))

    base = F.concat(*map(numbered, range(len(KINDS))))
    label = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(label, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    more = F.coalesce(F.col("more"), F.array().cast("array<struct<k:int,start:int,end:int>>"))
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat(base, more))).alias("spans"), F.size(more).cast("long").alias("added"))
