import os

import pytest
from pyspark.sql import functions as F

from volley.sources import results as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_written_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    a = spark.createDataFrame([("001", "P0", 1), ("001", "P1", 2), (None, "P1", 3)], "recording_id string, port string, v int")
    n = spark.createDataFrame([(1,)], "k int")
    R.write_tables({"spikes": a, "notes": n}, path)
    R.write_tables({"spikes": a.filter("port = 'P0'").withColumn("v", F.col("v") + 10), "notes": n.withColumn("k", F.lit(5))}, path)
    assert rows(R.read_table(spark, path, "spikes")) == sorted([("001", "P0", 11), ("001", "P1", 2), (None, "P1", 3)], key=str)
    assert rows(R.read_table(spark, path, "notes")) == [(5,)]
    R.write_tables({"spikes": a.limit(0)}, path)
    assert R.read_table(spark, path, "spikes").count() == 3
    with pytest.raises(FileNotFoundError):
        R.read_table(spark, path, "nothing")


def test_a_write_killed_midway_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.createDataFrame([("r", 1)], "recording_id string, v int")
    R.write_tables({"spikes": good, "units": good}, path)
    bad = good.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        R.write_tables({"spikes": good.withColumn("v", F.lit(2)), "units": bad}, path)
    assert len(os.listdir(tmp_path / "out/spikes")) == 2  # the new folder is there, but no manifest names it
    assert rows(R.read_table(spark, path, "spikes")) == rows(R.read_table(spark, path, "units")) == [("r", 1)]
    R.write_tables({"units": good.withColumn("v", F.lit(3))}, path)
    assert rows(R.read_table(spark, path, "units")) == [("r", 3)] and rows(R.read_table(spark, path, "spikes")) == [("r", 1)]


def test_edited_result_round_trip(spark, tmp_path):
    spikes = spark.createDataFrame([("r", "P0", 0, 12), ("r", "P0", 0, 19), ("r", "P1", 0, 3)], "recording_id string, port string, unit_id long, sample_idx long")
    sources = spark.range(30).selectExpr("'r' recording_id", "'P0' port", "0L unit_id", "id sample_idx", "cast(id as double) s").unionByName(spark.range(5).selectExpr("'r' recording_id", "'P1' port", "0L unit_id", "id sample_idx", "-1d s"))
    units = spark.createDataFrame([("r", "P0", 0, "noisy", True, 0.91), ("r", "P1", 0, None, False, None)], "recording_id string, port string, unit_id long, notes string, flagged boolean, sil double")
    history = R.log_entries(spark.createDataFrame([("r", "P0", 0, 1, "edit", [1, 2], [2, 5])], "recording_id string, port string, unit_id long, seq long, event_type string, before array<long>, after array<long>"))
    spans = spark.createDataFrame([("r", 10, 20)], "recording_id string, start long, end long")
    keep = spark.createDataFrame([(1.5,)], "w double")
    made = R.edited_result(spikes, sources, units, history, spans, {"w_mat": keep, "filters": keep, "cache": keep})
    assert set(made) == {"spikes", "sources", "units", "history", "w_mat", "filters_original"}
    R.write_tables(made, str(tmp_path / "o"))
    back = {n: R.read_table(spark, str(tmp_path / "o"), n) for n in made}
    assert rows(back["spikes"].select("port", "sample_idx")) == [("P0", 2), ("P0", 9), ("P1", -7)]
    assert rows(back["sources"].select("port", "sample_idx", "s")) == sorted([("P0", k, k + 10.0) for k in range(10)] + [("P1", k, -1.0) for k in range(5)], key=str)
    assert all(rows(back[n].select(made[n].columns)) == rows(made[n]) for n in ("units", "history", "w_mat", "filters_original"))
    assert rows(R.edited_result(spikes, sources, units, history, spans, full=False)["spikes"]) == rows(spikes)


def test_log_entries(spark):
    df = spark.createDataFrame([(1, "edit", [3, 1, 3], [1, 9, 7]), (2, "undo", [3, 1], [1, 9]), (3, "redo", [3, 1], [1, 9]), (4, "flag", None, None), (5, "edit", [], [2]), (6, "edit", None, [2])], "seq long, event_type string, before array<long>, after array<long>")
    got = {r.seq: (r.samples_added, r.samples_removed) for r in R.log_entries(df).collect()}
    assert got == {1: ([7, 9], [3]), 2: ([3], [9]), 3: ([9], [3]), 4: ([], []), 5: ([2], []), 6: ([], [])}
