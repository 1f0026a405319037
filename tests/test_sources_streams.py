import io
import tarfile

import numpy as np
import pandas as pd
import pytest

from volley.sources import recordings as R
from volley.streaming import edits as L


def cells(df, kind="emg"):
    p = df.filter(f"kind = '{kind}'").toPandas()
    return p.pivot(index="sample_idx", columns="channel", values="x").to_numpy()


def test_ingest(spark, tmp_path):
    g = np.random.default_rng(0)
    m = g.normal(size=(50, 4)).astype(np.float32)
    for d in ("npy", "bin", "csv", "otb"):
        (tmp_path / d).mkdir()
    np.save(tmp_path / "npy/a.npy", m.T)
    (tmp_path / "bin/a.bin").write_bytes(m.tobytes())
    pd.DataFrame(m).to_csv(tmp_path / "csv/a.csv", header=False, index=False)
    raw = (m * 1000).astype("<i2")
    xml = '<Device Name="QUATTROCENTO" DeviceTotalChannels="4" ad_bits="16"><Channels><Adapter ChannelStartIndex="0" Gain="150"/><Adapter ChannelStartIndex="2" Gain="50"/><Adapter ChannelStartIndex="4" Gain="1"/></Channels></Device>'
    with tarfile.open(tmp_path / "otb/a.otb+", "w") as tar:
        for name, data in [("x.sig", raw.tobytes()), ("x.xml", xml.encode()), ("1.sip", np.arange(9.0).tobytes()), ("2.sip", np.arange(7.0).tobytes())]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    assert np.array_equal(cells(R.read_recordings(spark, str(tmp_path / "npy"), "npy")), m)
    assert np.array_equal(cells(R.read_recordings(spark, str(tmp_path / "bin"), "bin", n_channels=4)), m)
    assert np.allclose(cells(R.read_recordings(spark, str(tmp_path / "csv"), "csv")), m)
    otb = R.read_recordings(spark, str(tmp_path / "otb"), "otb+")
    assert np.allclose(cells(otb), raw * (5000 / 2**16 / np.array([150, 150, 50, 50])), rtol=1e-5)
    assert cells(otb, "aux").shape == (7, 2)
    named = xml.replace('"QUATTROCENTO"', '"QUATTROCENTO;rev 2"').replace('"16"', '"32"')
    for name, device, sig in (("named", named, (m * 1000).astype("<i4").tobytes()), ("nameless", xml.replace('Name="QUATTROCENTO" ', ""), raw.tobytes()), ("other", xml.replace("QUATTROCENTO", "MUOVI"), raw.tobytes()), ("torn", xml, raw.tobytes()[:-2])):
        (tmp_path / name).mkdir()
        with tarfile.open(tmp_path / name / "a.otb+", "w") as tar:
            for part, data in (("x.sig", sig), ("x.xml", device.encode())):
                info = tarfile.TarInfo(part)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    assert np.allclose(cells(R.read_recordings(spark, str(tmp_path / "named"), "otb+")), (m * 1000).astype("<i4") * (5000 / 2**32 / np.array([150, 150, 50, 50])), rtol=1e-5)
    for name in ("nameless", "other", "torn"):
        with pytest.raises(Exception, match="not supported|ends within"):
            R.read_recordings(spark, str(tmp_path / name), "otb+").count()
    with pytest.raises(ValueError):
        R.read_recordings(spark, str(tmp_path), "mat")


def folded(events, depth=L.DEPTH):
    done, undone = [], []
    for seq, kind in events:
        if kind == "edit":
            done = [*done, seq][-depth:]
            undone = []
        elif kind == "undo" and done:
            undone.append(done.pop())
        elif kind == "redo" and undone:
            done.append(undone.pop())
    return ",".join(map(str, done))


def test_edit_fold_batch_and_stream(spark, tmp_path):
    g = np.random.default_rng(2)
    rows = [(int(g.integers(0, 5)), k, str(g.choice(["edit", "undo", "redo", "flag"], p=[0.5, 0.25, 0.2, 0.05]))) for k in range(400)]
    df = spark.createDataFrame(rows, "unit_id long, seq long, event_type string")
    want = {u: folded([(s, e) for x, s, e in rows if x == u]) for u in {r[0] for r in rows}}
    assert {r.unit_id: r.done for r in L.fold_edit_log(df).collect()} == want
    for k in range(4):  # four files, one batch each
        df.filter(f"seq >= {k * 100} and seq < {k * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    seen = []
    q = L.stream_edit_fold(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.unit_id: r.done for r in seen} == want


def test_stream_isi_equals_batch(spark, tmp_path):
    rows = [(u, t) for u in range(3) for t in range(u, 60, 3 + u)]
    df = spark.createDataFrame(rows, "unit_id long, sample_idx long")
    for lo in (0, 30):
        df.filter(f"sample_idx >= {lo} and sample_idx < {lo + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    seen = []
    L.stream_isi(stream).writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    want = {(u, t): (3 + u if t - (3 + u) >= u else None) for u, t in rows}
    assert {(r.unit_id, r.sample_idx): r.isi for r in seen} == want


def test_stream_firing_metrics_equals_batch(spark, tmp_path):
    """In files by time, one batch each, over sliding windows; what the watermark has not passed at the end stays open."""
    rows = [(u, 60 * k * (u + 1)) for u in range(2) for k in range(200)]
    df = spark.createDataFrame(rows, "unit_id long, s long").selectExpr("unit_id", "timestamp_seconds(1700000000 + s) as ts")
    for k in range(4):
        df.filter(f"unix_seconds(ts) >= {1700000000 + k * 6000} and unix_seconds(ts) < {1700000000 + (k + 1) * 6000}").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    seen = []
    q = L.stream_firing_metrics(stream, "1 hour", "10 minutes", "30 minutes").writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {tuple(r) for r in L.stream_firing_metrics(df, "1 hour", "10 minutes", "30 minutes").collect()}
    assert len(seen) == len(set(seen)) and set(seen) <= batch and len(seen) > len(batch) // 2
    assert {r[4] for r in batch if r[0] == 0 and r[2] > 1} == {60.0}


def test_bursts_close_by_timer_and_free_their_state(spark, tmp_path):
    """Out of order within the watermark; the last file only moves it."""
    g = np.random.default_rng(0)
    rows = [(u, int(t)) for u in range(4) for t in np.sort(g.integers(0, 40_000, 25))] + [(9, 200_000)]
    df = spark.createDataFrame(rows, "unit_id long, s long").selectExpr("unit_id", "timestamp_seconds(1700000000 + s) as ts", "s")
    for k, part in enumerate(("s < 12000 and s % 7 > 0", "s < 12000 and s % 7 = 0 or s >= 12000 and s < 40000", "s = 200000")):
        df.filter(part).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema("unit_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b"))
    seen = []
    q = L.stream_bursts(stream, 1_800_000, "5 hours").writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cpb")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in L.burst_counts(df.filter("unit_id < 9"), "30 minutes").collect()}
    assert len(seen) == len(set(seen)) and {(u, s, n) for u, s, n in seen} == want and len(want) > 12
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the unit whose burst is still open
