import math

import numpy as np
import pytest

from volley.functions.selection import percentiles


def plain(values, share):
    """Linear interpolation between the nearest ranks; NaN is the largest value."""
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    at = share * (len(v) - 1)
    a = v[math.floor(at)]
    return a if at == math.floor(at) else a + (at - math.floor(at)) * (v[math.floor(at) + 1] - a)


def same(a, b):
    return a == b or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12))


@pytest.mark.parametrize("bins, leaf", [(4096, 4096), (16, 3)])
def test_against_sorting(spark, bins, leaf):
    g = np.random.default_rng(0)
    groups = {
        "normal": g.normal(size=400).tolist(), "ties": g.integers(0, 3, 300).astype(float).tolist(), "one": [4.5], "two": [1.0, 2.0], "equal": [7.0] * 50, "null": [None] * 3,
        "nulls": [None, 1.0, None, 5.0], "skewed": (10.0 ** g.uniform(-300, 300, 200)).tolist(), "wide": [-1.7e308, 1.7e308, 0.0, 1.0, -5.0] * 3, "tiny": [5e-324, 0.0, 1e-323] * 4,
        "odd": [float("nan"), float("inf"), -float("inf"), 3.0, 4.0, 5.0] * 5, "nan": [float("nan")] * 4, "inf": [-float("inf")] * 9 + [1.0],
    }
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "g string, x double").repartition(5)
    for share in (0.02, 0.5, 1.0):
        got = {r.g: r.value for r in percentiles(df, ["g"], "x", share, bins, leaf).collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            assert same(got[k], plain(v, share)), (k, share, got[k], plain(v, share))


def test_no_group_and_no_rows(spark):
    df = spark.createDataFrame([(float(k % 97),) for k in range(500)], "x double")
    assert [r.value for r in percentiles(df, [], "x", 0.25, 8, 5).collect()] == [plain([float(k % 97) for k in range(500)], 0.25)]
    assert [r.value for r in percentiles(df.limit(0), [], "x", 0.25).collect()] == [None]
    assert percentiles(df.limit(0).selectExpr("x", "1 as g"), ["g"], "x", 0.25).collect() == []


def test_a_hot_group_is_never_gathered(spark):
    """The largest list that a group ends with has `leaf` values, and samples meet no shuffle before."""
    df = spark.range(20_000).selectExpr("cast(id % 2 as int) as channel", "cast(sin(id) * 1000 as double) as x")
    out = percentiles(df, ["channel"], "x", 0.02, 64, 50)
    for r in out.collect():
        assert same(r.value, plain([math.sin(k) * 1000 for k in range(r.channel, 20_000, 2)], 0.02)) or abs(r.value) <= 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
