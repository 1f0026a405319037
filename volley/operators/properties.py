"""The table of a unit's properties that every view reads, its renewal after edits, and the table of qualities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volley.functions.scratch import written
from volley.operators.duplicates import rate_of_agreement
from volley.operators.signal import center_muap, centroids, group_of, muap_features, muap_spectrum, pnr_db, spike_triggered_average
from volley.operators.trains import firing_stats, port_of, quality_flags, unit_of

MUAP = ["muap_ptp", "muap_energy", "muap_waveform_length", "muap_peak_freq", "muap_median_freq", "muap_mean_freq"]


def muap_table(samples: DataFrame, spikes: DataFrame, half: int, fs: float) -> DataFrame:
    """The features of the centred action potentials of each unit of a port (samples may name the port or not)."""
    key = unit_of(spikes)
    own = samples if "port" in samples.columns else None
    if own is None:  # one port's samples: every unit is of that port
        by = group_of(samples)
        names = written(spikes.select(*key).distinct().withColumn("_id", F.monotonically_increasing_id()), "units")
        trains = spikes.join(names, key).select(*by, F.col("_id").alias("unit_id"), "sample_idx")
        muap = center_muap(spike_triggered_average(samples, trains, half))
        out = muap_features(muap).join(muap_spectrum(muap, fs), [*by, "unit_id"], "left")
        return out.drop(*by).withColumnRenamed("unit_id", "_id").join(names, "_id").select(*key, *MUAP)
    muap = center_muap(spike_triggered_average(samples, spikes.select(*key, "sample_idx"), half))
    return muap_features(muap).join(muap_spectrum(muap, fs), key, "left").select(*key, *MUAP)


def duplicate_candidates(spikes: DataFrame, tol: int, least: float) -> DataFrame:
    """(unit, duplicates): a map from the other units of the port that agree in at least `least` to that rate, directed."""
    key = unit_of(spikes)
    roa = rate_of_agreement(spikes, tol, least=least, same_port=True)
    entries = F.sort_array(F.collect_list(F.struct(F.col("unit_b").alias("other"), "roa")))  # of one port's units
    return roa.select(*key[:-2], F.col("port_a").alias("port"), F.col("unit_a").alias("unit_id"), "unit_b", "roa").groupBy(*key).agg(F.map_from_entries(entries).alias("duplicates"))


def port_properties(units: DataFrame, spikes: DataFrame, sources: DataFrame, peaks: DataFrame, fs: float, samples: DataFrame | None = None, half: int = 0, tol: int = 0, least: float = 0.3) -> DataFrame:
    """A row a unit of units: firing, quality and action potential properties, reliability and flags, and duplicate
    candidates. spikes: (unit, sample_idx, height), clipped; sources: (unit, sample_idx, s); peaks: maxima of the squared
    source (unit, sample_idx, s). Without samples the action potential's features are null; a unit without spikes has
    n_spikes 0 and nulls. All parts are aggregates by the same key, so they share one partitioning."""
    key = unit_of(units)
    at = spikes.select(*key, "sample_idx").distinct()
    marked = peaks.select(*key, "sample_idx", "s").join(at.withColumn("_spike", F.lit(True)), [*key, "sample_idx"], "left")
    noise = marked.filter("_spike is null").select(*key, "s", F.lit(False).alias("is_spike"))
    true = sources.join(at, [*key, "sample_idx"]).select(*key, (F.col("s") * F.col("s")).alias("s"), F.lit(True).alias("is_spike"))
    out = units.select(*key).join(firing_stats(spikes, fs), key, "left").join(centroids(true.unionByName(noise)), key, "left").join(pnr_db(sources, at), key, "left")
    if samples is not None:
        out = out.join(muap_table(samples, spikes, half, fs), key, "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in MUAP})
    out = quality_flags(out.withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0))))
    return out.join(duplicate_candidates(spikes, tol, least), key, "left")


def recompute_units(before: DataFrame, changed: DataFrame, spikes: DataFrame, sources: DataFrame, peaks: DataFrame, fs: float, samples: DataFrame | None = None, half: int = 0) -> DataFrame:
    """Before (a table of port_properties) with the rows of the units in changed computed anew from their spikes; the
    others stay untouched and are not computed. Without samples the features of the old action potential stay, unless
    the unit has no spikes left. Duplicate candidates stay as they are: they are found over a whole port."""
    key = unit_of(before)
    some = changed.select(*key).distinct()
    only = lambda df: df.join(some, key, "left_semi")
    new = port_properties(only(before), only(spikes), only(sources), only(peaks), fs, None if samples is None else samples, half, 0, 2.0).drop("duplicates")
    old = before.select(*key, "duplicates", *[F.col(c).alias(f"_{c}") for c in MUAP])
    new = new.join(old, key).withColumns({c: F.when(F.col("n_spikes") > 0, F.coalesce(c, f"_{c}")) for c in MUAP})
    return before.join(some, key, "left_anti").unionByName(new.select(*before.columns))


def quality_table(ranks: DataFrame, properties: DataFrame, sil: float = 0.8, pnr: float = 32.0) -> DataFrame:
    """H6: SIL and PNR of each ranked unit (unknown or not a number: 0), and whether they reach their thresholds."""
    key = unit_of(ranks)
    value = lambda c: F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))
    out = ranks.join(properties.select(*key, "sil", "pnr_db"), key, "left").withColumns({"sil": value("sil"), "pnr_db": value("pnr_db")})
    return out.select(*port_of(ranks), "unit_id", "rank", "sil", "pnr_db", (F.col("sil") >= sil).alias("sil_ok"), (F.col("pnr_db") >= pnr).alias("pnr_ok"))
