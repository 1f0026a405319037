"""Spike-triggered averages and their removal, as products of spike indicators and blocks of samples. No row for each spike,
channel and offset is ever made: what is shuffled are samples, sums by (unit, channel, offset) and packed waveforms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples of a block of averages, and of one from which waveforms are taken away (where they are sent to each block).
AVERAGED, PEELED = 1024, 8192


def group_of(df: DataFrame) -> list[str]:
    return [c for c in ("recording_id", "port") if c in df.columns]


def units_in(df: DataFrame) -> list[str]:
    return [*group_of(df), "unit_id"]


def _blocks(at: Column, half: int, block: int) -> Column:
    """The blocks that [at - half, at + half] touches; half is at most a block."""
    return F.explode(F.array_distinct(F.array(*[F.floor((at + k) / block) for k in (-half, 0, half)])))


def _column(part: pa.Table, name: str) -> np.ndarray:
    return part[name].to_numpy()


def ends_of(samples: DataFrame) -> DataFrame:
    """First and last sample of each group."""
    return samples.groupBy(*group_of(samples)).agg(F.min("sample_idx").alias("_lo"), F.max("sample_idx").alias("_hi"))


def spike_triggered_average(samples: DataFrame, spikes: DataFrame, half: int, ends: DataFrame | None = None) -> DataFrame:
    """(unit, channel, off, v): means over the spikes whose whole window lies in the recording.

    A block of samples (and a halo of `half` on both sides) meets the spikes inside it. For each unit it gives one sum a
    channel and offset, over all its spikes of the block; Spark adds these up, first inside each task. Samples that are
    missing or null don't count; repeated rows of a sample or of a spike count as often as they occur. ends: those of the
    recording, if samples are not all of it.
    """
    by, unit, block = group_of(samples), units_in(spikes), max(AVERAGED, 2 * half)
    ends = ends_of(samples) if ends is None else ends
    inside = spikes.join(ends, by) if by else spikes.crossJoin(F.broadcast(ends))
    inside = inside.filter((F.col("sample_idx") - half >= F.col("_lo")) & (F.col("sample_idx") + half <= F.col("_hi")))
    left = samples.filter("x is not null").select(*by, _blocks(F.col("sample_idx"), half, block).alias("_b"), "channel", "sample_idx", F.col("x").cast("double").alias("x"))
    right = inside.select(*unit, F.floor(F.col("sample_idx") / block).alias("_b"), "sample_idx")
    only = [c for c in unit if c not in by]  # unit_id, and what else tells units of a group apart
    wave = pa.list_(pa.struct([("s", pa.float64()), ("n", pa.float64())]))
    kinds = [*[spikes.schema[c] for c in by], *[spikes.schema[c] for c in only], samples.schema["channel"]]
    kinds.append(T.StructField("wave", T.ArrayType(T.StructType([T.StructField("s", T.DoubleType()), T.StructField("n", T.DoubleType())]))))
    names = [f.name for f in kinds]

    def run(part: pa.Table, at: pa.Table) -> pa.Table:
        if not part.num_rows or not at.num_rows:
            return pa.table({n: pa.array([], wave if n == "wave" else (part if n == "channel" else at).schema.field(n).type) for n in names})
        channel, c = np.unique(_column(part, "channel"), return_inverse=True)
        t, own = _column(part, "sample_idx"), _column(at, "sample_idx")
        first, width = int(min(t.min(), own.min())) - half, 2 * half + 1
        x, there = np.zeros((2, len(channel), int(max(t.max(), own.max())) - first + half + 1))
        np.add.at(x, (c, t - first), _column(part, "x"))
        np.add.at(there, (c, t - first), 1)
        units = at.group_by(only).aggregate([("sample_idx", "list")])
        sums = np.zeros((units.num_rows, 2, len(channel), width))
        for k, spikes_of in enumerate(units["sample_idx_list"].to_pylist()):
            for s in spikes_of:
                a = s - half - first
                sums[k, 0] += x[:, a : a + width]
                sums[k, 1] += there[:, a : a + width]
        flat = pa.StructArray.from_arrays([pa.array(sums[:, k].ravel()) for k in (0, 1)], ["s", "n"])
        rows = np.repeat(np.arange(units.num_rows), len(channel))
        out = {c: pa.array([at[c][0].as_py()] * len(rows), at.schema.field(c).type) for c in by}
        out |= {c: units[c].take(pa.array(rows)) for c in only}
        out["channel"] = pa.array(np.tile(channel, units.num_rows)).cast(part.schema.field("channel").type)
        out["wave"] = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), flat)
        return pa.table({n: out[n] for n in names})

    parts = left.groupBy(*by, "_b").cogroup(right.groupBy(*by, "_b")).applyInArrow(run, T.StructType(kinds))
    parts = parts.select(*unit, "channel", F.posexplode("wave").alias("off", "e")).filter("e.n > 0")
    return parts.groupBy(*unit, "channel", (F.col("off") - half).alias("off")).agg((F.sum("e.s") / F.sum("e.n")).alias("v"))


def filter_from_spikes(samples: DataFrame, spikes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """D12 with a window of one sample: a filter by unit, scaled to absolute sum 1."""
    sta, unit = spike_triggered_average(samples, spikes, 0, ends), units_in(spikes)
    return sta.select(*unit, "channel", F.try_divide("v", F.sum(F.abs("v")).over(Window.partitionBy(*unit))).alias("w"))


def take_away(samples: DataFrame, spikes: DataFrame, waves: DataFrame, half: int) -> DataFrame:
    """samples less the waveform (unit, channel, off, v) of each spike's unit at the spike; overlaps add up.

    A block of samples meets the spikes inside it and its halo, a list for each unit, with the packed waveforms of these
    units: the transpose of the average. Nothing is broadcast, and rows of a unit's spikes are joined with a row a
    channel, not a row a channel and offset.
    """
    by, unit, block = group_of(samples), units_in(spikes), max(PEELED, 2 * half)
    only = [c for c in unit if c not in by]
    packed = waves.groupBy(*unit, "channel").agg(F.sort_array(F.collect_list(F.struct("off", "v"))).alias("wave"))
    at = spikes.select(*unit, _blocks(F.col("sample_idx"), half, block).alias("_b"), "sample_idx").groupBy(*unit, "_b").agg(F.collect_list("sample_idx").alias("at"))
    right = at.join(packed, unit).select(*by, "_b", *only, "channel", "at", "wave")
    left = samples.withColumns({"x": F.col("x").cast("double"), "_b": F.floor(F.col("sample_idx") / block)})
    places = [left.columns.index(c) for c in samples.columns]

    def run(part: pa.Table, peeled: pa.Table) -> pa.Table:
        out = part.select(places)
        if not part.num_rows or not peeled.num_rows:
            return out
        channel, c = np.unique(_column(part, "channel"), return_inverse=True)
        t = _column(part, "sample_idx")
        first, width = int(t.min()) - 2 * half, 2 * half + 1
        gone = np.zeros((len(channel), int(t.max()) - first + 2 * half + 1))
        peeled = peeled.filter(pc.is_in(peeled["channel"], pa.array(channel).cast(peeled.schema.field("channel").type)))
        units = peeled.append_column("_row", pa.array(np.arange(peeled.num_rows))).group_by(only).aggregate([("_row", "list")])
        row = np.searchsorted(channel, _column(peeled, "channel"))
        wave = peeled["wave"].combine_chunks()
        size = wave.value_lengths().to_numpy()
        end, flat = np.cumsum(size), wave.flatten()
        off, v = flat.field("off").to_numpy() + half, flat.field("v").to_numpy()
        for k in range(units.num_rows):
            rows = np.array(units["_row_list"][k].as_py())
            take = np.repeat(end[rows] - np.cumsum(size[rows]), size[rows]) + np.arange(size[rows].sum())
            shape = np.zeros((len(channel), width))
            shape[np.repeat(row[rows], size[rows]), off[take]] = v[take]
            for s in peeled["at"][int(rows[0])].as_py():
                a = s - half - first
                if 0 <= a and a + width <= gone.shape[1]:  # else out of reach
                    gone[:, a : a + width] += shape
        return out.set_column(out.schema.get_field_index("x"), "x", pc.subtract(out["x"], pa.array(gone[c, t - first])))

    kinds = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name == "x" else f for f in samples.schema.fields])
    return left.groupBy(*by, "_b").cogroup(right.groupBy(*by, "_b")).applyInArrow(run, kinds)


def peel_off(samples: DataFrame, spikes: DataFrame, half: int) -> DataFrame:
    """Samples less the spike-triggered average at every spike; overlaps add up."""
    return take_away(samples, spikes, spike_triggered_average(samples, spikes, half), half)


def near(samples: DataFrame, spikes: DataFrame, half: int) -> DataFrame:
    """The samples within reach of spikes, by whole blocks: all that an average at these spikes reads but for the ends of
    the recording. spikes should be few, a written table: its blocks are joined, and broadcast by Spark where small."""
    by, block = group_of(samples), max(PEELED, 2 * half)
    blocks = spikes.select(*by, _blocks(F.col("sample_idx"), half, block).alias("_b")).distinct()
    return samples.withColumn("_b", F.floor(F.col("sample_idx") / block)).join(blocks, [*by, "_b"], "left_semi").select(*samples.columns)
