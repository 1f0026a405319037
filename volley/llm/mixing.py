"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A classifier learned from a table of labelled documents gives each document a posterior over domains. Document rates
are then fitted by projected gradient descent, so that the expected token totals of the domains have the target shares.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volley.llm.shared import join_small, materialize, unused

SLOTS = 1 << 14
SAMPLE_DOCS = 4000
SPACE, SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"
#: Domains of the labels table and the shares of tokens aimed at.
TARGETS = {"high": 0.80, "low": 0.12, "toxic": 0.08}
_TAUS = [2.0**-k for k in range(10)]


def label_domain(quality: Column, toxic: Column) -> Column:
    """Null if a label that is needed is null."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


def _dot(a: list[Column], b: list) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def _slots(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, key, n_tokens, first, slot): a row a distinct lower-cased word of each row of docs, `first` true for
    one of them; a text without words has one row, of slot -1. The text is cut once."""
    whole = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *more, F.xxhash64(whole).alias("key"), F.split(F.btrim(F.lower(whole), F.lit(SPACES)), SPACE).alias("words"))
    none = F.get("words", F.lit(0)) == ""
    rows = rows.select("doc_id", *more, "key", F.when(none, 0).otherwise(F.size("words")).cast("long").alias("n_tokens"), F.array_distinct("words").alias("words"))
    rows = rows.select("doc_id", *more, "key", "n_tokens", F.posexplode("words").alias("at", "w"))
    slot = F.when(F.col("w") == "", -1).otherwise(F.pmod(F.xxhash64("w"), F.lit(SLOTS))).cast("int")
    return rows.select("doc_id", *more, "key", "n_tokens", (F.col("at") == 0).alias("first"), slot.alias("slot"))


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, key, m, n_tokens, p_<domain>...): one row a distinct (doc_id, text), m rows of docs each.

    labels: (doc_id, domain). About `sample` labelled documents of each domain (chosen by a hash of the id; the
    documented bound) train naive Bayes over the documents' distinct words, hashed to SLOTS slots; the other half of a
    twice as large sample sets the temperature, so that the posteriors are calibrated. Text without words, or null, has
    the prior. Domains without a label have posterior 0; with no labels at all the posterior is uniform.
    """
    labels = labels.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sizes = {r.domain: r.n for r in labels.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("domain") == d, F.lit(min(1.0, 2 * sample / n))) for d, n in sizes.items()], F.lit(0.0))
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000))
    chosen = materialize(labels.filter(dealt < share * 1_000_000).withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)) == 0), "chosen")
    fit = join_small(docs.select("doc_id", "text"), chosen.filter("fit").drop("fit"), "doc_id", "inner")  # before any text is cut
    counts = _slots(fit, "domain").groupBy("slot").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(d) for d in domains], *[F.sum((F.col("first") & (F.col("domain") == d)).cast("long")).alias(f"n_{d}") for d in domains])
    counts = materialize(counts, "counts")  # SLOTS + 1 rows at most
    tot = counts.agg(*[F.coalesce(F.sum(F.when(F.col("slot") >= 0, F.col(d))), F.lit(0)).alias(d) for d in domains], *[F.coalesce(F.sum(f"n_{d}"), F.lit(0)).alias(f"n_{d}") for d in domains]).first()
    n = sum(tot[f"n_{d}"] for d in domains)
    prior = {d: float(np.log(max(tot[f"n_{d}"], 1e-9) / n)) if n else 0.0 for d in domains}
    weight = counts.filter("slot >= 0").select("slot", *[F.log((F.col(d) + 0.5) / F.lit(tot[d] + 0.5 * SLOTS)).alias(f"w_{d}") for d in domains])
    unseen = {d: float(np.log(0.5 / (tot[d] + 0.5 * SLOTS))) for d in domains}
    scored = _slots(docs).join(F.broadcast(weight), "slot", "left")
    m = F.count(F.when(F.col("first"), 1))
    own = {d: F.sum(F.coalesce(f"w_{d}", F.when(F.col("slot") == -1, 0.0).otherwise(unseen[d]))) for d in domains}
    scored = scored.groupBy("doc_id", "key", "n_tokens").agg(m.alias("m"), *[(own[d] / m + prior[d]).alias(f"s_{d}") for d in domains])
    scored = materialize(scored, "scores")

    def log_p(tau: Column) -> dict[str, Column]:
        return {d: (F.col(f"s_{d}") - F.col("top")) * tau - F.log(sum((F.exp((F.col(f"s_{x}") - F.col("top")) * tau) for x in domains[1:]), F.exp((F.col(f"s_{domains[0]}") - F.col("top")) * tau))) for d in domains}

    scored = scored.withColumn("top", F.array_max(F.array(*[f"s_{d}" for d in domains])))
    held = join_small(scored, chosen.filter("not fit").drop("fit"), "doc_id", "inner").withColumn("tau", F.explode(F.array(*map(F.lit, _TAUS))))
    own = held.select("tau", F.coalesce(*[F.when(F.col("domain") == d, log_p(F.col("tau"))[d]) for d in domains]).alias("l"))
    fits = own.groupBy("tau").agg(F.avg("l").alias("l")).collect()  # a row a temperature
    tau = F.lit(max(((r.l, r.tau) for r in fits), default=(0, 1.0))[1])
    return scored.select("doc_id", "key", "n_tokens", "m", *[F.exp(log_p(tau)[d]).alias(f"p_{d}") for d in domains])


def fit_rates(state: DataFrame, targets: Mapping[str, float], least: float = 0.0, total: float | None = None, steps: int = 64, tolerance: float = 1e-4) -> DataFrame:
    """state (n_tokens, m, p_<domain>) with `rate` >= least, so that sum(rate * n_tokens * p_d) is near weight_d * total.

    Minimises the squared distance of totals and goals, in the metric of M = sum(m * n_tokens * p p') inverted, by
    gradient steps in the metric of the token counts of the documents that a step can move (those above the least rate,
    or drawn up from it), each projected onto rate >= least. Without the bound one step ends it. A step is two aggregates
    of a few numbers; one that leads away is taken back.
    total None: the tokens there are or, with a least rate over 0, a quarter more than the smallest total for which
    no domain must shrink. Domains that no document belongs to are left out and the other shares scaled up. An empty
    state stays empty. It ends when every total is within `tolerance` of its goal (as a share of total) or eight
    steps haven't lessened the distance by a hundredth, because the goals are out of reach; then it warns, naming what
    is left.
    """
    names = [d for d in targets]
    p = [F.col(f"p_{d}") for d in names]
    mass = F.col("n_tokens").cast("double") * F.col("m")

    def totals(df: DataFrame, rate: Column) -> list[float]:
        return [x or 0.0 for x in df.agg(*[F.sum(rate * mass * q) for q in p]).first()]

    base = totals(state, F.lit(1.0))
    used = [k for k, x in enumerate(base) if x > 1e-9 and targets[names[k]] > 0]
    whole = sum(targets[names[k]] for k in used) or 1.0
    if total is None:
        total = 1.25 * least * max((base[k] * whole / targets[names[k]] for k in used), default=0.0) if least > 0 else sum(base)
    goal = [targets[names[k]] / whole * total if k in used else 0.0 for k in range(len(names))]
    pairs = [(a, b) for a in range(len(p)) for b in range(a + 1)]

    def gram_of(df: DataFrame) -> np.ndarray:
        out = np.zeros((len(p), len(p)))
        for (a, b), x in zip(pairs, df.agg(*[F.sum(mass * p[a] * p[b]) for a, b in pairs]).first()):
            out[a, b] = out[b, a] = x or 0.0
        return out

    gram = gram_of(state)

    def inverted(m: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(m + 1e-9 * (np.trace(gram) + 1) * np.eye(len(p)), hermitian=True)

    inverse = inverted(gram)
    state = state.withColumn("rate", F.greatest(F.lit(float(least)), F.lit(1.0)))
    kept, off, best, since, scale = state, np.zeros(len(p)), float("inf"), 0, 1.0
    for step in range(steps):
        now = np.subtract(totals(state, F.col("rate")), goal)
        gap = float(now @ now)
        if gap < best:
            since = 0 if gap < best * 0.99 else since + 1
            kept, off, best = state, now, gap
        else:  # too far: back to the best rates, and on by shorter steps
            state, since, scale = kept, since + 1, scale / 2
        if np.abs(off).max() <= tolerance * max(total, 1e-9) or since >= 8:
            break
        down = _dot(p, [F.lit(float(v)) for v in inverse @ off])
        x = scale * inverted(gram_of(state.filter((F.col("rate") > least) | (down < 0)))) @ off  # of the documents that the step can move
        state = state.withColumn("rate", F.greatest(F.lit(float(least)), F.col("rate") - _dot(p, [F.lit(float(v)) for v in x])))
        if step % 4 == 3:
            state = materialize(state, "rates")
    if np.abs(off).max() > tolerance * max(total, 1e-9):
        warnings.warn(f"rates after {step + 1} steps are {np.abs(off).max() / max(total, 1e-9):.2g} of the total off a goal", stacklevel=2)
    return kept


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], least: float = 0.0, total: float | None = None, seed: int = 7, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, key, n_tokens, m, p_<domain>..., rate, copies) for each distinct (doc_id, text) of docs.

    copies is the rate rounded up with the probability of its fraction, by a hash of id, text and seed. key is
    xxhash64 of the text (null as empty)."""
    state = materialize(posteriors(docs, labels, list(targets), sample), "posteriors")
    out = fit_rates(state, targets, least, total)
    u = F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return out.withColumn("copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def apply_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs, each row as often as its copies say; columns as in docs."""
    i, k, k0, n, c = unused(docs, "id", "key", "own", "copies", "c")
    rows = mixed.select(F.col("doc_id").alias(i), F.col("key").alias(k), F.col("copies").cast("int").alias(n))
    named = docs.withColumn(k0, F.xxhash64(F.coalesce("text", F.lit(""))))
    out = named.join(rows, named["doc_id"].eqNullSafe(rows[i]) & (named[k0] == rows[k]))
    return out.filter(F.col(n) > 0).withColumn(c, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
