"""Exact percentiles of long groups by distributed selection: no task gathers the values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volley.functions.scratch import written

#: Bins of a pass over a group's values; values of a group that are sorted in one place in the end.
BINS, LEAF = 4096, 4096
_INF = float("inf")


def _octave(x: Column) -> Column:
    """Ascending in x and even in its exponent: 0 at 0, one more for each doubling."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1080))


def _bin(x: Column, bins: int, by_octave: bool) -> Column:
    """Ascending in x: -1 for minus infinity, 0 to bins - 1 from lo to hi, bins for infinity, then NaN. Halves where hi - lo
    is beyond the largest double."""
    lo, hi = F.col("_lo"), F.col("_hi")
    if by_octave:
        share = F.try_divide(_octave(x) - _octave(lo), _octave(hi) - _octave(lo))
    else:
        share = F.when(hi - lo == _INF, F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)).otherwise(F.try_divide(x - lo, hi - lo))
    inside = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return F.when(F.isnan(x), bins + 1).when(x == _INF, bins).when(x == -_INF, -1).otherwise(inside)


def percentiles(df: DataFrame, by: list[str], column: str, share: float, bins: int = BINS, leaf: int = LEAF) -> DataFrame:
    """(by, value): the percentile `share` (0 to 1) of column in each group, interpolated between the two nearest ranks.

    Nulls are left out; a group of nulls only has value null, an empty table no group. NaN counts as the largest value.
    A pass counts a group's values in `bins` bins, of equal width and of equal ratio by turns, and keeps the bin with the wanted rank, whose least and largest value
    are the bounds of the next; when at most `leaf` values are left (or all are equal), those are sorted. Between passes
    there is a row a group. The values are read once a pass and reach no shuffle before the last one: what moves are at
    most `bins` counts a group and task.
    """
    by = list(by)
    df = df.select(*by, F.col(column).cast("double").alias("_x"))
    finite = F.when(~F.isnan("_x") & (F.abs("_x") < _INF), F.col("_x"))
    state = df.groupBy(*by).agg(F.count("_x").alias("_size"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count(finite).alias("_finite"))
    place = F.lit(float(share)) * F.greatest(F.col("_size") - 1, F.lit(0))
    none = F.lit(None).cast("double")
    # _k: rank wanted among the _size values in _lo to _hi, from 0; _next: the value that follows them, _done: the one found
    odd = (F.col("_size") > F.col("_finite")) & (F.col("_size") > 0)
    state = state.select(*by, "_size", F.coalesce("_lo", F.lit(0.0)).alias("_lo"), F.coalesce("_hi", F.lit(0.0)).alias("_hi"), F.floor(place).alias("_k"), (place - F.floor(place)).alias("_part"), none.alias("_next"), none.alias("_done"), odd.alias("_odd"))
    state = written(state, "ranks")
    open_ = F.col("_done").isNull() & (F.col("_odd") | (F.col("_size") > leaf) & (F.col("_lo") < F.col("_hi")))
    by_octave = False
    while not (going := state.filter(open_)).isEmpty():
        rows = _joined(df.filter("_x is not null"), going, by).filter("_odd or _x >= _lo and _x <= _hi")
        counts = rows.groupBy(*by, _bin(F.col("_x"), bins, by_octave).alias("_bin")).agg(F.count("*").alias("_n"), F.min("_x").alias("_a"), F.max("_x").alias("_z"))
        w = Window.partitionBy(*by).orderBy("_bin")  # at most bins + 3 rows a group
        upto = counts.withColumns({"_upto": F.sum("_n").over(w), "_after": F.lead("_a").over(w)})
        hit = _joined(upto, going, by).filter("_upto > _k and _upto - _n <= _k")
        special = (F.col("_bin") < 0) | (F.col("_bin") >= bins)  # infinities and NaN: all values of such a bin are equal
        new = hit.select(*by, F.col("_n").alias("_size"), F.when(special, 0.0).otherwise(F.col("_a")).alias("_lo"), F.when(special, 0.0).otherwise(F.col("_z")).alias("_hi"), (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_k"), "_part", F.coalesce("_after", "_next").alias("_next"), F.when(special, F.col("_a")).alias("_done"), F.lit(False).alias("_odd"))
        state, by_octave = written(state.filter(~open_).unionByName(new), "ranks"), not by_octave
    equal = F.coalesce("_done", F.when((F.col("_size") > 0) & (F.col("_lo") == F.col("_hi")), F.col("_lo")))
    state = state.withColumn("_equal", equal)
    few = _joined(df.filter("_x is not null"), state.filter("_equal is null and _size > 0"), by).filter("_x >= _lo and _x <= _hi")
    few = few.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias("_all"))  # `leaf` values at most
    out = state.join(few, by, "left") if by else state.crossJoin(F.broadcast(few)) if not few.isEmpty() else state.withColumn("_all", F.lit(None).cast("array<double>"))
    first = F.coalesce("_equal", F.try_element_at("_all", (F.col("_k") + 1).cast("int")))
    inside = F.when(F.col("_equal").isNotNull() & (F.col("_k") + 1 < F.col("_size")), F.col("_equal")).otherwise(F.try_element_at("_all", (F.col("_k") + 2).cast("int")))
    second = F.coalesce(inside, "_next")
    return out.select(*by, F.when(F.col("_part") == 0, first).otherwise(first + F.col("_part") * (second - first)).alias("value"))


def _joined(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """rows with the state of their group: a row a group, broadcast by Spark where the written state is small."""
    return rows.join(state, by) if by else rows.crossJoin(F.broadcast(state))
