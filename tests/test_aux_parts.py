"""Aux channels of a task are dealt by file to as many tasks as their rows need."""

import pytest

from volley.operators import config as C


@pytest.mark.parametrize("mode, want", [("strict", {("a", "Index Ext"), ("b", "Index Ext"), ("b", "x"), ("b", None)}), ("lenient", {("a", "Index Ext"), ("b", "Index Ext"), ("b", "x")})])
def test_tasks_grow_with_rows(spark, monkeypatch, mode, want):
    monkeypatch.setattr(C, "ROWS", 10)
    names = [f"{f}{k}" for f in "ab" for k in range(10)]
    aux = spark.createDataFrame([(f, u) for f in names for u in ("Index Ext", "x", None)], "file string, unit string")
    tasks = spark.createDataFrame([(f, g, "Ext") for f in names if f[0] == "a" for g in ("Index", "Little", "Index")], "name string, finger string, target string")
    out = C.select_aux_for_task(aux, tasks, mode)
    assert sorted(map(str, ((r.file, r.unit) for r in out.collect()))) == sorted(str((f, u)) for f in names for g, u in want if f[0] == g)
    d = out.distinct()
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("hashpartitioning(file") == plan.count("Exchange hash") == 2 and ", 6), REPARTITION_BY_NUM" in plan
