import json

import pytest

from volley.operators import config as C


def test_sessions_keep_what_documents_say(spark):
    port = {"name": "P", "electrode": {"channels": [3, 5]}}
    said = {"name": "s", "input_dir": "in", "output_dir": "out", "aux_channels": [{"name": "force"}], "auto_save": False, "undo_levels": 7, "ports": [port]}
    df = spark.createDataFrame([("a", json.dumps(said)), ("b", json.dumps({"ports": [port, port | {"enabled": False}]}))], "file string, doc string")
    got = {(r.file, r.local_idx): r for r in C.load_sessions(df).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    a, b = got["a", 1], got["b", 0]
    assert (a.session, a.channel, a.input_dir, a.output_dir, json.loads(a.aux_channels), a.auto_save, a.undo_levels) == ("s", 5, "in", "out", [{"name": "force"}], False, 7)
    assert (b.session, b.fs, b.input_dir, b.aux_channels, b.auto_save, b.undo_levels) == ("unnamed", 2048.0, "", "[]", True, 50)


def test_overrides_of_channel_configurations(spark):
    grids = [{"name": "g", "type": "Surface", "start_chan": 0, "end_chan": 64}, {"name": "h", "start_chan": 64, "end_chan": 74}]
    df = spark.createDataFrame([("a", json.dumps({"grids": grids, "loader": ".npy"}))], "file string, doc string")
    g, h = C.load_channel_config(df, {"iterations": 50, "notch_filter": "50", "lowpass_hz": 900}).orderBy("port").collect()
    assert (g.loader, g.etype, g.extension_factor, g.lowpass_hz, g.iterations, g.notch_filter, g.peel_off_repeats) == (".npy", "surface_grid", 16, 900, 50, "50", True)
    assert (h.etype, h.extension_factor, h.fitness) == ("intramuscular", 100, "CoV")
    with pytest.raises(ValueError):
        C.load_channel_config(df, {"itrations": 5})
