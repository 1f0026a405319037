import numpy as np
import pandas as pd
import pytest

from volley.streaming import edits as L


def plain(events, depth):
    done, undone = [], []
    L._fold(pd.DataFrame(sorted(events), columns=["seq", "event_type"]), done, undone, depth)
    return len(done), len(undone), ",".join(map(str, done))


@pytest.mark.parametrize("depth, events, fan", [(100, 10_000, 64), (5, 7, 3), (1, 3, 2), (100, 50, 4)])
def test_blocks_of_a_log_compose(spark, monkeypatch, depth, events, fan):
    """One unit has most of all events; its blocks are put together in several rounds."""
    monkeypatch.setattr(L, "FAN", fan)
    g = np.random.default_rng(depth)
    logs = {}
    for u, n in {1: 1500, 2: 40, 3: 1, 4: 3, 5: 200}.items():
        seq = np.sort(g.choice(10 * n + 5, n, replace=False))
        bias = [(0.5, 0.3, 0.15), (0.2, 0.5, 0.25), (0.7, 0.1, 0.1)][u % 3]
        logs[u] = [(int(s), str(k)) for s, k in zip(seq, g.choice(["edit", "undo", "redo", "flag"], n, p=[*bias, 1 - sum(bias)]))]
    logs[6] = [(k, "undo" if k % 2 else "redo") for k in range(20)]
    logs[7] = [(k, "edit") for k in range(300)] + [(300 + k, "undo") for k in range(150)] + [(450 + k, "redo") for k in range(20)]
    logs[8] = [(1, "flag")]
    rows = [(u, s, k) for u, log in logs.items() for s, k in log]
    df = spark.createDataFrame(rows, "unit_id long, seq long, event_type string").repartition(5)
    got = {r.unit_id: (r.n_done, r.n_undone, r.done) for r in L.fold_edit_log(df, depth, events).collect()}
    assert got == {u: plain(log, depth) for u, log in logs.items()}
    assert L.fold_edit_log(df.limit(0), depth, events).collect() == []


def test_tables_of_blocks_are_functions_of_the_state():
    """The table of a concatenation is that of one block after the other, on every state."""
    g = np.random.default_rng(0)
    for depth in (1, 3, 10):
        parts = [g.integers(0, 3, n) for n in (0, 5, 40)]
        every = L._states(depth)

        def table(kinds, depth=depth, every=every):
            height, top = every.copy()
            base = np.zeros_like(height)
            L._walk(kinds, height, base, top, depth)
            return np.stack([height, base, top])

        state = np.stack([every[0], np.zeros_like(every[0]), every[1]])
        for p in parts:
            state = L._apply(table(p), state)
        assert np.array_equal(state, table(np.concatenate(parts)))
