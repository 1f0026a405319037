"""Files by byte ranges: whatever the size of a range, the samples are those of the array."""

import io

import numpy as np
import pandas as pd
import pytest

from volley.sources import ranges as S
from volley.sources import recordings as R


def cells(df, kind="emg"):
    p = df.filter(f"kind = '{kind}'").toPandas()
    return p.pivot(index="sample_idx", columns="channel", values="x").to_numpy()


@pytest.mark.parametrize("size", [4, 100, 1 << 25])
@pytest.mark.parametrize("order", ["C", "F"])
def test_arrays_of_both_orders_in_ranges(spark, tmp_path, size, order):
    m = np.random.default_rng(0).normal(size=(23, 5)).astype(np.float32)
    for name, a in (("long", m), ("wide", m.T), ("flat", m[:, 0]), ("ints", (m * 1000).astype("<i2"))):
        (tmp_path / name).mkdir()
        np.save(tmp_path / name / "r.npy", np.asarray(a, order=order))
    read = lambda name, **o: R.read_recordings(spark, str(tmp_path / name), "npy", bytes=size, **o)
    assert np.array_equal(cells(read("long")), m) and np.array_equal(cells(read("wide")), m)
    assert np.array_equal(cells(read("flat")), m[:, :1]) and np.array_equal(cells(read("ints")), (m * 1000).astype("<i2"))
    assert np.array_equal(cells(read("wide", orientation="samples_first")), m.T)
    assert np.array_equal(cells(read("wide", channels=[1, 3])), m[:, 1:3]) and np.array_equal(cells(read("wide", channels=[4, 0, 2])), m[:, [4, 0, 2]])
    assert read("long").rdd.getNumPartitions() == {4: 23 if order == "C" else 115, 100: 5, 1 << 25: 1}[size]


def test_layouts(spark, tmp_path):
    m = np.arange(60, dtype=np.float32).reshape(20, 3)
    np.savez(tmp_path / "a.npz", data=m, torque=m[:, 0], t=np.arange(20.0))
    layout = {"name": "n", "format": "npz", "fields": {"emg": {"path": "emg", "fallback_keys": ["Data", "data"]}, "force": {"path": "force", "fallback_keys": ["torque"]}}}
    got = R.read_layout(spark, str(tmp_path / "a.npz"), layout, bytes=64)
    assert np.array_equal(cells(got), m) and np.array_equal(cells(got, "force"), m[:, :1]) and got.select("kind").distinct().count() == 2
    for bad, error in (({"name": "n", "format": "npz"}, "needs name"), (layout | {"format": "mat"}, "not one of"), (layout | {"fields": {"emg": {"path": "x"}}}, "none of"), (layout | {"fields": {"emg": {"path": "data", "orientation": "up"}}}, "orientation")):
        with pytest.raises(Exception, match=error):
            R.read_layout(spark, str(tmp_path), bad).count()
    np.savez_compressed(tmp_path / "a.npz", emg=m)
    with pytest.raises(Exception, match="compressed"):
        R.read_layout(spark, str(tmp_path), layout | {"fields": {"emg": {"path": "emg"}}}).count()


def test_headers_and_torn_files():
    buffer = io.BytesIO()
    np.save(buffer, np.zeros((3, 2)))
    buffer.seek(0)
    at, shape, dtype, fortran = S.npy_header(buffer)
    assert (shape, dtype, fortran) == ((3, 2), "<f8", False) and len(buffer.getvalue()) == at + 48
    with pytest.raises(ValueError, match="not an array"):
        S.npy_header(io.BytesIO(b"PK....................."))


def test_a_torn_array_is_an_error(spark, tmp_path):
    np.save(tmp_path / "r.npy", np.zeros((30, 2)))
    data = (tmp_path / "r.npy").read_bytes()
    (tmp_path / "r.npy").write_bytes(data[:-8])
    with pytest.raises(Exception, match="ends before"):
        R.read_recordings(spark, str(tmp_path), "npy").count()
    (tmp_path / "r.npy").write_bytes(b"")
    with pytest.raises(Exception, match="not an array"):
        R.read_recordings(spark, str(tmp_path), "npy").count()


def test_a_long_csv_is_split(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(700, 3))
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        pd.DataFrame(m).to_csv(tmp_path / name, header=False, index=False, lineterminator=end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = R.read_csv(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        for name in ("a.csv", "b.csv"):
            assert np.allclose(cells(df.filter(df.recording_id == name)), m)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
