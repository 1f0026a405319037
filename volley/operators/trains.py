"""Spike trains: intervals, firing statistics, set edits, rule-based cleaning, ordering and population rates.

spikes has port, unit_id, sample_idx and mostly height, and recording_id if there are several recordings: then everything
is done within a recording. Every window is partitioned by the unit, so one shuffle serves a whole chain of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volley.functions.scratch import written

UNIT = ["port", "unit_id"]
RL, RG, AL, AG, MAX_RATE, MIN_SPIKES = 0.331, 0.339, 0.539, 0.508, 50.0, 4


def unit_of(df: DataFrame) -> list[str]:
    """The columns that name a unit: port and unit_id and, where there is one, the recording."""
    return [*(["recording_id"] if "recording_id" in df.columns else []), *UNIT]


def port_of(df: DataFrame) -> list[str]:
    return unit_of(df)[:-1]


def by_unit(key: list[str]) -> Window:
    return Window.partitionBy(*key).orderBy("sample_idx")


def clip_spikes(spikes: DataFrame, n_samples: int) -> DataFrame:
    """Spikes in [0, n_samples), duplicates once."""
    key = unit_of(spikes)
    return spikes.filter((F.col("sample_idx") >= 0) & (F.col("sample_idx") < n_samples)).dropDuplicates([*key, "sample_idx"])


def with_isi(spikes: DataFrame) -> DataFrame:
    """Isi, samples since the unit's spike before; null at its first."""
    key = unit_of(spikes)
    return spikes.withColumn("isi", F.col("sample_idx") - F.lag("sample_idx").over(by_unit(key)))


def firing_stats(spikes: DataFrame, fs: float) -> DataFrame:
    """n_spikes, discharge_rate, cov_isi (percent), min_isi_ms; rates are null below two spikes."""
    key = unit_of(spikes)
    return with_isi(spikes).groupBy(*key).agg(
        F.count("*").alias("n_spikes"),
        F.try_divide(F.lit(float(fs)), F.avg("isi")).alias("discharge_rate"),
        F.try_divide(100 * F.stddev_pop("isi"), F.avg("isi")).alias("cov_isi"),
        (F.min("isi") * 1000.0 / fs).alias("min_isi_ms"),
    )


def quality_flags(props: DataFrame, sil: float = 0.9, pnr: float = 30, cov: float = 40, rates: tuple = (3, 40), n: int = 10) -> DataFrame:
    """is_reliable (0.8 / 32, unknown is false) and one flag a threshold."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return props.withColumns({
        "is_reliable": ok((F.col("sil") >= 0.8) & (F.col("pnr_db") >= 32)),
        "sil_ok": ok(F.col("sil") >= sil),
        "pnr_ok": ok(F.col("pnr_db") >= pnr),
        "cov_ok": ok(F.col("cov_isi") <= cov),
        "rate_ok": ok(F.col("discharge_rate").between(*rates)),
        "count_ok": ok(F.col("n_spikes") >= n),
    })


def reliability_summary(units: DataFrame) -> DataFrame:
    """Units, reliable and other, by port and (port null) in all; by recording if there are several."""
    return units.rollup(*port_of(units)).agg(F.count("*").alias("total"), F.count_if("is_reliable").alias("reliable"), F.count_if(~F.col("is_reliable")).alias("not_reliable"))


def ifr_trace(spikes: DataFrame, fs: float) -> DataFrame:
    """At the middle of each pair, its rate; 0 for intervals up to 10 ms."""
    key = unit_of(spikes)
    s = F.col("isi") / float(fs)
    return with_isi(spikes).filter("isi is not null").select(*key, ((F.col("sample_idx") - F.col("isi") / 2.0) / fs).alias("t"), F.when(s > 0.01, F.try_divide(F.lit(1.0), s)).otherwise(0.0).alias("rate"))


def train_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Samples added and removed, as rows."""
    key = [*unit_of(before), "sample_idx"]
    added = after.select(*key).distinct().join(before, key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.select(*key).distinct().join(after, key, "left_anti").withColumn("change", F.lit("removed")))


def remove_spikes(spikes: DataFrame, gone: DataFrame) -> DataFrame:
    """The train without the samples of gone, each once."""
    key = unit_of(spikes)
    return spikes.join(gone, [*key, "sample_idx"], "left_anti").dropDuplicates([*key, "sample_idx"])


def merge_spikes(spikes: DataFrame, new: DataFrame) -> DataFrame:
    """Both trains, each sample once."""
    key = unit_of(spikes)
    return spikes.select(*key, "sample_idx").unionByName(new.select(*key, "sample_idx")).distinct()


def rule1_low_height(spikes: DataFrame) -> DataFrame:
    """drops low spikes. In a run of spikes below min(RL * neighbours' mean, RG * mean) all go; after a run of odd
    length the next spike goes as well if it is below RG * mean."""
    key = unit_of(spikes)
    u = Window.partitionBy(*key)
    near = by_unit(key).rowsBetween(-2, 2)
    around = F.try_divide(F.sum("height").over(near) - F.col("height"), F.count("*").over(near) - 1)
    s = spikes.withColumns({"_mean": F.avg("height").over(u), "_local": F.coalesce(around, F.col("height"))})
    s = s.withColumns({"_g": F.col("height") < RG * F.col("_mean"), "_c": F.col("height") < F.least(RL * F.col("_local"), RG * F.col("_mean"))})
    # place in the run: spikes since the last one that isn't in a run
    s = s.withColumn("_rn", F.row_number().over(by_unit(key)))
    s = s.withColumn("_place", F.col("_rn") - F.coalesce(F.max(F.when(~F.col("_c"), F.col("_rn"))).over(by_unit(key)), F.lit(0)))
    s = s.withColumn("_run", F.lag("_place", 1, 0).over(by_unit(key)))
    return s.filter(~F.col("_c") & ~(F.col("_g") & (F.col("_run") % 2 == 1))).select(*spikes.columns)


def _drop_lower(s: DataFrame, columns: list[str]) -> DataFrame:
    """Of each bad pair (k, k + 1) the lower spike goes (k if equal); pairs that touch a dropped spike are passed over.

    s has _bad and _hi (the lower one is k + 1) on the pair's first spike. In a run of bad pairs that would drop their
    second spike, the 1st, 3rd, ... do so."""
    key = unit_of(s)
    s = s.withColumn("_m", F.col("_bad") & F.col("_hi")).withColumn("_rn", F.row_number().over(by_unit(key)))
    s = s.withColumn("_place", F.col("_rn") - F.coalesce(F.max(F.when(~F.col("_m"), F.col("_rn"))).over(by_unit(key)), F.lit(0)))
    s = s.withColumn("_r", F.col("_m") & (F.col("_place") % 2 == 1))
    s = s.withColumn("_before", F.coalesce(F.lag("_r").over(by_unit(key)), F.lit(False)))
    return s.filter(~F.col("_before") & ~(F.col("_bad") & ~F.col("_hi") & ~F.col("_before"))).select(*columns)


def _pairs(spikes: DataFrame, fs: float) -> DataFrame:
    """The rate of the pair a spike begins, null at the last."""
    key = unit_of(spikes)
    nxt = F.lead("sample_idx").over(by_unit(key))
    return spikes.withColumns({"_next_h": F.lead("height").over(by_unit(key)), "_rate": F.when(nxt.isNotNull(), F.try_divide(F.lit(float(fs)), nxt - F.col("sample_idx")))})


def _deviation(values: Column) -> Column:
    """Population deviation of an array, added up value by value in Welford's form as in the queries' SQL, to the last bit:
    rates are fractions of small numbers, and one may equal mean + 2 deviations. stddev_pop rounds otherwise."""
    mean = lambda a, x: a["mean"] + (x - a["mean"]) / (a["n"] + 1.0)
    more = lambda a, x: F.struct((a["n"] + 1.0).alias("n"), mean(a, x).alias("mean"), (a["m2"] + (x - mean(a, x)) * (x - a["mean"])).alias("m2"))
    return F.aggregate(values, F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "m2")]), more, lambda a: F.sqrt(F.try_divide(a["m2"], a["n"])))


def _local_rate(s: DataFrame) -> DataFrame:
    """Mean and deviation of the rates from 5 pairs before to 4 after; a lone rate is its own mean, deviation 0."""
    key = unit_of(s)
    w = by_unit(key).rowsBetween(-5, 4)
    n = F.count("_rate").over(w)
    s = s.withColumns({"_fm": F.when(n < 2, F.col("_rate")).otherwise(F.avg("_rate").over(w)), "_rates": F.collect_list("_rate").over(w)})
    return s.withColumn("_fs", F.when(F.size("_rates") < 2, 0.0).otherwise(_deviation(F.col("_rates")))).drop("_rates")


def rule2_high_rate(spikes: DataFrame, fs: float) -> DataFrame:
    """of a pair with a rate above 50 Hz or twice the local mean, or above mean + 2 deviations with one spike far
    lower, the lower spike goes."""
    key = unit_of(spikes)
    u = Window.partitionBy(*key)
    s = _local_rate(_pairs(spikes, fs)).withColumns({"_hm": F.avg("height").over(u), "_hs": F.stddev_pop("height").over(u)})
    lo, hi = F.least("height", "_next_h"), F.greatest("height", "_next_h")
    strong = (F.col("_rate") > MAX_RATE) | (F.col("_rate") > 2 * F.col("_fm"))
    weak = (F.col("_rate") > F.col("_fm") + 2 * F.col("_fs")) & (hi - lo > 0.5 * lo) & (lo < F.greatest(F.col("_hm") - 2 * F.col("_hs"), F.lit(0.0)))
    s = s.withColumns({"_bad": F.coalesce(strong | weak, F.lit(False)), "_hi": F.coalesce(F.col("_next_h") < F.col("height"), F.lit(False))})
    return _drop_lower(s, spikes.columns)


def remove_ifr_outliers(spikes: DataFrame, fs: float) -> DataFrame:
    """pairs with a rate above max(Q75 + 1.5 IQR, 2 median) lose their lower spike; needs 3 spikes and 4 rates."""
    key = unit_of(spikes)
    s = _pairs(spikes, fs)
    q = s.groupBy(*key).agg(F.count("*").alias("_n"), F.count("_rate").alias("_nr"), F.percentile("_rate", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*key, F.when((F.col("_n") >= 3) & (F.col("_nr") >= 4), F.greatest(2.5 * F.get("_q", F.lit(2)) - 1.5 * F.get("_q", F.lit(0)), 2 * F.get("_q", F.lit(1)))).alias("_limit"))
    s = s.join(q, key).withColumns({"_bad": F.coalesce(F.col("_rate") > F.col("_limit"), F.lit(False)), "_hi": F.coalesce(F.col("_next_h") < F.col("height"), F.lit(False))})
    return _drop_lower(s, spikes.columns)


def with_neighbours(sources: DataFrame, spikes: DataFrame, block: int = 4096) -> DataFrame:
    """source samples (unit, sample_idx, s) from a unit's first spike to before its last, with the spikes around each:
    _p1, _p2 (before or at), _n1, _n2 (after), as structs (sample_idx, height).

    A pair of neighbouring spikes is put where it begins and at the start of each further block of samples that it
    reaches; each sample takes the last pair at or before it in its block. A window runs over one block of a unit."""
    key = unit_of(sources)
    k = F.struct("sample_idx", "height")
    pairs = spikes.select(*key, k.alias("_p1"), *[f(k, n).over(by_unit(key)).alias(c) for c, f, n in (("_p2", F.lag, 1), ("_n1", F.lead, 1), ("_n2", F.lead, 2))]).filter("_n1 is not null")
    first = F.floor(F.col("_p1.sample_idx") / block)
    pairs = pairs.withColumn("_b", F.explode(F.sequence(first, F.floor((F.col("_n1.sample_idx") - 1) / block))))
    pair = F.struct("_p1", "_p2", "_n1", "_n2")
    pairs = pairs.select(*key, "_b", F.greatest(F.col("_p1.sample_idx"), F.col("_b") * block).alias("_at"), F.lit(0).alias("_row"), pair.alias("_pair"))
    row = F.struct(*sources.columns)
    samples = sources.select(*key, F.floor(F.col("sample_idx") / block).alias("_b"), F.col("sample_idx").alias("_at"), F.lit(1).alias("_row"), row.alias("_sample"))
    w = Window.partitionBy(*key, "_b").orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0)
    near = samples.unionByName(pairs, allowMissingColumns=True).withColumn("_pair", F.last("_pair", True).over(w)).filter("_row = 1 and _at < _pair._n1.sample_idx")
    return near.select("_sample.*", (F.col("_pair._p1.sample_idx") == F.col("_at")).alias("_is_spike"), "_pair.*")


def _context(mean_height: str) -> dict[str, Column]:
    """Mean height of up to two spikes on each side, and the two acceptance levels."""
    parts = [F.col(f"{c}.height") for c in ("_p2", "_p1", "_n1", "_n2")]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    n = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    hm = F.coalesce(F.try_divide(total, n), F.col(mean_height))
    return {"_plus": F.greatest(AL * hm, AG * F.col(mean_height)), "_minus": F.least(AL * hm, AG * F.col(mean_height))}


def rule3_add_peaks(spikes: DataFrame, sources: DataFrame, fs: float) -> DataFrame:
    """in windows of fs / min(50, twice the mean rate) samples from the first to the last spike, the highest sample
    (the first of equals) is added if it isn't a spike, is high enough and its new rate plausible."""
    key = unit_of(spikes)
    isi = with_isi(spikes)
    stats = isi.groupBy(*key).agg(F.min("sample_idx").alias("_t0"), F.max("sample_idx").alias("_t1"), F.avg("height").alias("_hm"), F.avg(float(fs) / F.col("isi")).alias("_fm"), F.count("*").alias("_n")).filter("_n >= 2")
    stats = stats.withColumn("_fhat", F.least(F.lit(MAX_RATE), 2 * F.col("_fm"))).withColumn("_win", F.greatest(F.lit(1), F.floor(fs / F.col("_fhat"))).cast("long"))
    near = with_neighbours(sources, spikes).join(stats, key).filter("sample_idx >= _t0 and sample_idx < _t1")
    near = near.withColumn("_w", F.floor((F.col("sample_idx") - F.col("_t0")) / F.col("_win")))
    row = F.struct("sample_idx", "s", "_is_spike", "_p1", "_p2", "_n1", "_n2", "_hm", "_fhat")
    top = near.groupBy(*key, "_w").agg(F.max_by(row, F.struct(F.col("s"), -F.col("sample_idx"))).alias("_x")).select(*key, "_x.*").filter("not _is_spike")
    top = top.withColumns(_context("_hm")).withColumn("_new", F.greatest(float(fs) / (F.col("sample_idx") - F.col("_p1.sample_idx")), F.try_divide(F.lit(float(fs)), F.col("_n1.sample_idx") - F.col("sample_idx"))))
    ok = ((F.col("s") > F.col("_plus")) & (F.col("_new") < MAX_RATE)) | ((F.col("_new") >= 2) & (F.col("_new") <= F.col("_fhat")) & (F.col("s") > F.col("_minus")))
    return spikes.select(*key, "sample_idx", "height").unionByName(top.filter(ok).select(*key, "sample_idx", F.col("s").alias("height")))


def rule4_fill_gaps(spikes: DataFrame, sources: DataFrame, fs: float) -> DataFrame:
    """in gaps with a rate below 0.7 of the local mean, the highest sample inside is added if it is high enough and
    both new rates are plausible, or if it parts the gap evenly. The gap is an equality on the last spike."""
    key = unit_of(spikes)
    gaps = _local_rate(_pairs(spikes, fs)).withColumn("_hm", F.avg("height").over(Window.partitionBy(*key)))
    gaps = gaps.filter((F.col("_fm") > 0) & (F.col("_rate") < 0.7 * F.col("_fm"))).select(*key, F.col("sample_idx").alias("_gap"), "_fm", "_fs", "_hm")
    inside = with_neighbours(sources, spikes).filter("not _is_spike").withColumn("_gap", F.col("_p1.sample_idx")).join(gaps, [*key, "_gap"])
    row = F.struct("sample_idx", "s", "_p1", "_p2", "_n1", "_n2", "_fm", "_fs", "_hm")
    top = inside.groupBy(*key, "_gap").agg(F.max_by(row, F.struct(F.col("s"), -F.col("sample_idx"))).alias("_x")).select(*key, "_x.*").withColumns(_context("_hm"))
    left, right = float(fs) / (F.col("sample_idx") - F.col("_p1.sample_idx")), float(fs) / (F.col("_n1.sample_idx") - F.col("sample_idx"))
    limit = F.col("_fm") + 2 * F.col("_fs")
    ok = ((F.col("s") > 0.5 * F.col("_plus")) & (left < limit) & (right < limit)) | ((F.col("s") > 0.5 * F.col("_minus")) & (F.least(left, right) / F.greatest(left, right) >= 0.7))
    return spikes.select(*key, "sample_idx", "height").unionByName(top.filter(ok).select(*key, "sample_idx", F.col("s").alias("height")))


def auto_edit(spikes: DataFrame, sources: DataFrame, fs: float) -> DataFrame:
    """rules 1 and 2, 3 and 4, 1 and 2 again for units of at least four spikes; others stay as they are. The train
    after each pair of rules is used several times and is written to the shared folder."""
    key = unit_of(spikes)
    spikes = spikes.select(*key, "sample_idx", "height")
    n = F.count("*").over(Window.partitionBy(*key))
    able, few = spikes.withColumn("_n", n).filter(F.col("_n") >= MIN_SPIKES).drop("_n"), spikes.withColumn("_n", n).filter(F.col("_n") < MIN_SPIKES).drop("_n")
    first = written(rule2_high_rate(rule1_low_height(able), fs), "train")
    more = written(rule3_add_peaks(first, sources, fs), "train")
    added = written(rule4_fill_gaps(more, sources, fs), "train")
    counted = added.withColumn("_n", n)
    again = rule2_high_rate(rule1_low_height(counted.filter(F.col("_n") >= MIN_SPIKES).drop("_n")), fs)
    return again.unionByName(counted.filter(F.col("_n") < MIN_SPIKES).drop("_n")).unionByName(few)


def _reached(rows: DataFrame, spans: DataFrame, block: int) -> DataFrame:
    """rows (unit, sample_idx) with each span (unit, s0 <= sample < s1) they lie in. A span is put into the blocks of
    samples that it touches, so rows meet the spans of their block, not all of their unit."""
    b = F.floor(F.col("sample_idx") / block)
    wide = spans.filter("s0 < s1").withColumn("_b", F.explode(F.sequence(F.floor(F.col("s0") / block), F.floor((F.col("s1") - 1) / block))))
    return rows.withColumn("_b", b).join(wide, [*unit_of(rows), "_b"]).filter("sample_idx >= s0 and sample_idx < s1").drop("_b")


def box_delete(spikes: DataFrame, boxes: DataFrame, block: int = 4096) -> DataFrame:
    """F8: spikes in any box (unit, s0, s1, y0, y1) of the unit go: s0 <= sample < s1 and y0 <= height <= y1."""
    key = unit_of(spikes)
    hit = _reached(spikes, boxes, block).filter("height between y0 and y1").select(*key, "sample_idx").distinct()
    return spikes.join(hit, [*key, "sample_idx"], "left_anti")


def delete_at(spikes: DataFrame, clicks: DataFrame, block: int = 4096) -> DataFrame:
    """for each click (unit, at) the nearest spike goes, the first of equally near ones: the last spike up to the
    click or the first one after, both by blocks."""
    key = unit_of(spikes)
    at = clicks.select(*key, F.col("at").cast("long").alias("sample_idx")).distinct()
    there = spikes.select(*key, "sample_idx", F.col("sample_idx").alias("x"))
    back = as_of(at, there, key, block).withColumnRenamed("x", "_back")
    turned = lambda df: df.withColumn("sample_idx", -F.col("sample_idx"))
    ahead = turned(as_of(turned(at), turned(there), key, block)).withColumnRenamed("x", "_ahead")
    gap = lambda c: F.abs(F.col(c) - F.col("sample_idx"))
    nearest = F.when(F.col("_ahead").isNull() | (gap("_back") <= gap("_ahead")), F.col("_back")).otherwise(F.col("_ahead"))
    hit = back.join(ahead, [*key, "sample_idx"]).select(*key, nearest.alias("sample_idx")).distinct()
    return spikes.join(hit, [*key, "sample_idx"], "left_anti")


def add_at(spikes: DataFrame, peaks: DataFrame, clicks: DataFrame, half: int, sources: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """for each click (unit, at) the nearest peak within half a window is added (the first of equals), if new; where
    there is no peak and sources are given, the highest sample of the window (the first of equals)."""
    key = unit_of(spikes)
    asked = clicks.select(*key, "at").distinct()
    spans = asked.select(*key, "at", (F.col("at") - half).alias("s0"), (F.col("at") + half + 1).alias("s1"))
    new = _reached(peaks, spans, block).groupBy(*key, "at").agg(F.min_by("sample_idx", F.struct(F.abs(F.col("sample_idx") - F.col("at")), "sample_idx")).alias("sample_idx"))
    if sources is not None:
        bare = spans.join(new.select(*key, "at"), [*key, "at"], "left_anti").withColumn("s1", F.col("s1") - 1)
        new = new.unionByName(_reached(sources, bare, block).groupBy(*key, "at").agg(F.min_by("sample_idx", F.struct(-F.col("s"), F.col("sample_idx"))).alias("sample_idx")))
    return merge_spikes(spikes, new)


def box_add(spikes: DataFrame, peaks: DataFrame, boxes: DataFrame, block: int = 4096) -> DataFrame:
    """peaks inside a box of the unit are added."""
    return merge_spikes(spikes, _reached(peaks, boxes, block).filter("height between y0 and y1"))


def toggle_flags(events: DataFrame) -> DataFrame:
    """a unit is flagged after an odd number of toggles."""
    key = unit_of(events)
    return events.groupBy(*key).agg((F.count("*") % 2 == 1).alias("flagged"))


def flag_unreliable(units: DataFrame, least: float = 0.9) -> DataFrame:
    """units that have properties and a SIL that is unknown or too low are flagged."""
    return units.withColumn("flagged", F.col("flagged") | (F.col("has_properties") & (F.col("sil").isNull() | (F.col("sil") < least))))


def delete_flagged(units: DataFrame) -> DataFrame:
    """flagged units go, the others are numbered anew from 0 in order, by port."""
    return units.filter("not flagged").withColumn("new_id", F.row_number().over(Window.partitionBy(*port_of(units)).orderBy("unit_id")) - 1)


def remap_peel_sequence(steps: DataFrame, kept: DataFrame) -> DataFrame:
    """steps of deleted units go, others get the new number, null steps stay; order is kept."""
    key = unit_of(steps)
    out = steps.join(kept.select(*key, "new_id"), key, "left").filter("unit_id is null or new_id is not null")
    port = port_of(steps)
    return out.select(*port, F.row_number().over(Window.partitionBy(*port).orderBy("step")).alias("step"), F.col("new_id").alias("unit_id"))


def order_units(spikes: DataFrame, units: DataFrame, fs: float, by: str = "first_spike") -> DataFrame:
    """H1: rank of each unit of a recording by first spike, id or mean rate; unknown last; ties by port and unit."""
    key = unit_of(spikes)
    stats = firing_stats(spikes, fs).join(spikes.groupBy(*key).agg(F.min("sample_idx").alias("first")), key)
    column = {"first_spike": "first", "id": "unit_id", "rate": "discharge_rate"}[by]
    return units.join(stats, key, "left").select(*key, F.col(column).alias("_key")).withColumn("rank", F.row_number().over(Window.partitionBy(*key[:-2]).orderBy(F.asc_nulls_last("_key"), *UNIT)) - 1).drop("_key")


def raster(spikes: DataFrame, ranks: DataFrame, fs: float) -> DataFrame:
    """H2: (rank, t) of each spike; a unit without spikes keeps its rank with t null."""
    key = unit_of(spikes)
    return ranks.join(spikes, key, "left").select(*key[:-2], "rank", (F.col("sample_idx") / float(fs)).alias("t"))


def rebin_spikes(spikes: DataFrame, fs: float, cap: float = 1000.0) -> DataFrame:
    """H3: spikes on a grid of at most cap Hz, halves to even, each bin once."""
    key = unit_of(spikes)
    return spikes.select(*key, F.bround(F.col("sample_idx") / (fs / min(fs, cap))).cast("long").alias("sample_idx")).distinct()


def _smoothed(bins: DataFrame, key: list[str], spark_hz: int, window_s: float) -> DataFrame:
    """(key, bin, rate) of bins (key, sample_idx, n: spikes there), each bin of a key once. The bins of a key are gathered in
    blocks of eight windows with a halo, a row a block, and rows are smoothed many at a time in arrays: what is shuffled
    are bins with spikes, not a row for each of them and each offset."""
    n = int(round(window_s * spark_hz))
    o = np.arange(-(n // 2), n - n // 2)
    w, size, wide = spark_hz * 2.0 / n * np.cos(3.141592653589793 * o / n) ** 2, 8 * n, 10 * n
    fields = [f for f in bins.schema.fields if f.name in key]
    at = F.col("sample_idx")
    rows = bins.withColumn("_b", F.explode(F.sequence(F.floor((at + int(o[0])) / size), F.floor((at + int(o[-1])) / size))))
    rows = rows.groupBy(*key, "_b").agg(F.collect_list(F.struct((at - F.col("_b") * size).cast("int").alias("x"), F.col("n").cast("double").alias("n"))).alias("_at"))  # ten windows of bins at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            lists, cells = batch.column("_at"), batch.num_rows * wide
            x, m = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in range(2))
            cell = np.repeat(np.arange(batch.num_rows) * wide + n, np.diff(lists.offsets.to_numpy())) + x
            rate = np.bincount((cell[:, None] + o).ravel(), (m[:, None] * w).ravel(), cells).reshape(-1, wide)[:, n : n + size]
            reached = np.cumsum(np.bincount(cell + o[0], minlength=cells + 1) - np.bincount(cell + o[-1] + 1, minlength=cells + 1))[:cells].reshape(-1, wide)[:, n : n + size]
            i, t = np.nonzero(reached)
            names = [batch.column(f.name).take(pa.array(i)) for f in fields]
            yield pa.RecordBatch.from_arrays([*names, pa.array(batch.column("_b").to_numpy()[i] * size + t), pa.array(rate[i, t])], [*(f.name for f in fields), "bin", "rate"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("bin", T.LongType()), T.StructField("rate", T.DoubleType())]))


def inst_discharge_rate(bins: DataFrame, spark_hz: int, window_s: float = 1.0) -> DataFrame:
    """H4: the rate of each unit smoothed by a Hann window of unit area: each spike adds its weights to the bins around it."""
    key = unit_of(bins)
    return _smoothed(bins.groupBy(*key, "sample_idx").agg(F.count("*").alias("n")), key, spark_hz, window_s)


def cumulative_spike_train(rates: DataFrame) -> DataFrame:
    """H5: the sum of the units' rates by bin."""
    return rates.groupBy(*unit_of(rates)[:-2], "bin").agg(F.sum("rate").alias("cst"))


def cumulative_discharge_rate(bins: DataFrame, spark_hz: int, window_s: float = 1.0) -> DataFrame:
    """H4 and H5 at once: smoothing is linear, so the units' spikes are added up by bin before they are smoothed."""
    by = unit_of(bins)[:-2]
    return _smoothed(bins.groupBy(*by, "sample_idx").agg(F.count("*").alias("n")), by, spark_hz, window_s).withColumnRenamed("rate", "cst")


def as_of(points: DataFrame, series: DataFrame, by: list[str], block: int = 4096) -> DataFrame:
    """points (by, sample_idx) with x of the last row of series (by, sample_idx, x) that isn't after: from the point's own
    block of samples, else carried over from the last block that has any (a row a block, not a sample, is in that window)."""
    b = F.floor(F.col("sample_idx") / block)
    own = points.withColumn("_b", b).withColumnRenamed("sample_idx", "_at").join(series.withColumn("_b", b), [*by, "_b"]).filter("sample_idx <= _at")
    own = own.groupBy(*by, "_at").agg(F.max_by("x", "sample_idx").alias("_own"))
    tails = series.groupBy(*by, b.alias("_b")).agg(F.max_by("x", "sample_idx").alias("_tail"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    asked = points.select(*by, b.alias("_b")).distinct()
    carried = asked.join(tails, [*by, "_b"], "full").withColumn("_carried", F.last("_tail", True).over(w)).drop("_tail")
    out = points.withColumn("_b", b).join(carried, [*by, "_b"], "left").join(own.withColumnRenamed("_at", "sample_idx"), [*by, "sample_idx"], "left")
    return out.withColumn("x", F.coalesce("_own", "_carried")).drop("_b", "_own", "_carried")


def recruitment_gain(spikes: DataFrame, force: DataFrame, fs: float) -> DataFrame:
    """For units of two spikes or more, the force at the first spike (the last force sample not after it, else the
    first) and the mean rate, intervals being at least 10 ms."""
    key = unit_of(spikes)
    by = key[:-2]
    s = with_isi(spikes).groupBy(*key).agg(F.min("sample_idx").alias("first"), F.try_divide(F.lit(1.0), F.avg(F.greatest(F.col("isi") / float(fs), F.lit(0.01)))).alias("mean_rate"), F.count("*").alias("n")).filter("n >= 2")
    low = force.groupBy(*by).agg(F.min("sample_idx").alias("lo"))  # a row a recording
    s = (s.join(low, by) if by else s.join(F.broadcast(low))).withColumn("sample_idx", F.greatest("first", "lo"))
    at = as_of(s.select(*by, "sample_idx").distinct(), force, by)
    return s.join(at, [*by, "sample_idx"]).select(*key, F.col("x").alias("force"), "mean_rate")


def gain_regression(gain: DataFrame) -> DataFrame:
    """Least squares of rate on force, null below three units."""
    ok = F.count("*") >= 3
    return gain.agg(F.count("*").alias("n"), F.when(ok, F.regr_slope("mean_rate", "force")).alias("slope"), F.when(ok, F.regr_intercept("mean_rate", "force")).alias("intercept"))
