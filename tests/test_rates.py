"""Smoothed rates by blocks of bins against the sum that defines them."""

import math
from collections import Counter

import numpy as np
import pytest

from volley.operators import trains as E


@pytest.mark.parametrize("hz, window", [(4, 1.0), (5, 1.0), (100, 0.25)])
def test_rates_over_edges_of_blocks(spark, hz, window):
    g = np.random.default_rng(hz)
    bins = {(f"R{k % 2}", "P", k): sorted(set(g.integers(-150, 700, 30 * k + 1).tolist())) for k in range(6)}
    df = spark.createDataFrame([(*k, t) for k, ts in bins.items() for t in ts], "recording_id string, port string, unit_id long, sample_idx long")
    n = int(round(hz * window))
    want, total = Counter(), Counter()
    for k, ts in bins.items():
        for t in ts:
            for o in range(-(n // 2), n - n // 2):
                w = hz * 2 / n * math.cos(math.pi * o / n) ** 2
                want[*k, t + o] += w
                total[k[0], t + o] += w
    rates = E.inst_discharge_rate(df, hz, window)
    assert {(r.recording_id, r.port, r.unit_id, r.bin): r.rate for r in rates.collect()} == pytest.approx(want)
    plan = rates._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1  # no row a spike and offset
    assert {(r.recording_id, r.bin): r.cst for r in E.cumulative_discharge_rate(df, hz, window).collect()} == pytest.approx(total)
    one = df.filter("recording_id = 'R1'").drop("recording_id")
    assert {r.bin: r.cst for r in E.cumulative_discharge_rate(one, hz, window).collect()} == pytest.approx({t: v for (r, t), v in total.items() if r == "R1"})
    assert E.inst_discharge_rate(df.limit(0), hz, window).collect() == []
