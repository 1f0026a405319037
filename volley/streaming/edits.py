"""Edit logs: undo and redo folded by unit, in batch and as a stream; streaming firing metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from volley.functions.scratch import written

DEPTH = 100
FOLDED = "unit_id long, n_done long, n_undone long, done string"


def _fold(rows: pd.DataFrame, done: list[int], undone: list[int], depth: int) -> None:
    for seq, kind in zip(rows.seq, rows.event_type):
        if kind == "edit":
            done.append(int(seq))
            del done[:-depth]
            undone.clear()
        elif kind == "undo" and done:
            undone.append(done.pop())
        elif kind == "redo" and undone:
            done.append(undone.pop())


def _row(unit: int, done: list[int], undone: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"unit_id": [unit], "n_done": [len(done)], "n_undone": [len(undone)], "done": [",".join(map(str, done))]})


#: Events of a block of a unit's log; blocks whose summaries are put together at a time.
EVENTS, FAN = 10_000, 64
KINDS = {"edit": 0, "undo": 1, "redo": 2}


def _walk(kinds: np.ndarray, height: np.ndarray, base: np.ndarray, top: np.ndarray, depth: int, heights: np.ndarray | None = None) -> None:
    """Runs events on many states at once, in place. A state counts edits ever stacked: `height` are in effect, those up to
    `base` forgotten, those up to `top` can be redone. heights: gets the first state's height after each event."""
    for k, kind in enumerate(kinds.tolist()):
        if kind == 0:
            height += 1
            top[:] = height
            np.maximum(base, height - depth, out=base)
        elif kind == 1:
            np.maximum(height - 1, base, out=height)
        elif kind == 2:
            np.minimum(height + 1, top, out=height)
        if heights is not None:
            heights[k] = height[0]


def _states(depth: int) -> np.ndarray:
    """All states relative to their base: rows height and top, height <= top <= depth, in the order of _state."""
    top = np.repeat(np.arange(depth + 1), np.arange(1, depth + 2))
    return np.stack([np.arange(len(top)) - top * (top + 1) // 2, top])


def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The states (rows height, base, top) behind a block of which table has the outcome of each relative state."""
    height, base, top = state
    at = (top - base) * (top - base + 1) // 2 + height - base
    return table[:, at] + base


def fold_edit_log(log: DataFrame, depth: int = DEPTH, events: int = EVENTS) -> DataFrame:
    """F16: the edits in effect for each unit after undo and redo; a new edit clears what was undone, and at most
    `depth` edits are remembered. Events of one seq go by their type.

    A unit with more than `events` events is cut into blocks by ranges of seq (so of no more events than seqs). Stacks
    have at most `depth` edits, so a block is a function on a few thousand states of heights: a small table, and tables
    compose. They are put together `FAN` at a time, from which each block gets the state it starts in. A block then says
    at which heights its edits were put, and the last edit at each height that is in effect in the end is one that
    counts: a grouping. No task sees more than a block, or `FAN` tables.
    """
    rows = log.select("unit_id", "seq", "event_type")
    size = rows.groupBy("unit_id").agg(F.count("*").alias("_n"), F.min("seq").alias("_a"), F.max("seq").alias("_z"))
    size = written(size.filter(F.col("_n") > events), "long-logs")

    def short(part: pd.DataFrame) -> pd.DataFrame:
        done: list[int] = []
        undone: list[int] = []
        _fold(part.sort_values(["seq", "event_type"]), done, undone, depth)
        return _row(int(part.unit_id.iloc[0]), done, undone)

    if size.isEmpty():
        return rows.groupBy("unit_id").applyInPandas(short, FOLDED)
    few = rows.join(size, "unit_id", "left_anti").select(*rows.columns).groupBy("unit_id").applyInPandas(short, FOLDED)
    return few.unionByName(_fold_long(rows.join(size, "unit_id"), depth, events))


def _fold_long(rows: DataFrame, depth: int, events: int) -> DataFrame:
    """The fold of units with many events, of rows with their number _n, and first and last seq _a, _z."""
    width = F.greatest(F.lit(1), F.ceil((F.col("_z") - F.col("_a") + 1) * events / F.col("_n")))
    block = F.floor((F.col("seq") - F.col("_a")) / width).cast("long")
    rows = rows.select("unit_id", block.alias("block"), "seq", "event_type")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["seq", "event_type"])
        part = part[part.event_type.isin(list(KINDS))]
        first = {c: int(part[c].iloc[0]) if len(part) else 0 for c in ("height", "base", "top")}
        state, heights = [np.array([v]) for v in first.values()], np.zeros(len(part), np.int64)
        kinds = part.event_type.map(KINDS).to_numpy()
        _walk(kinds, *state, depth, heights)
        last = pd.DataFrame({"h": heights[kinds == 0], "seq": part.seq[kinds == 0].to_numpy()}).drop_duplicates("h", keep="last")
        last = last[last.h > state[2][0] - 2 * depth]  # no other can be in effect at the end of the block
        return pd.DataFrame({"h": [0, *last.h], "seq": [-1, *last.seq], "height": int(state[0][0]), "base": int(state[1][0]), "top": int(state[2][0])})

    plain = rows.join(_starts(rows, depth), ["unit_id", "block"])

    def keyed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = run(part)
        out.insert(0, "unit_id", key[0])
        out.insert(1, "block", key[1])
        return out

    put = written(plain.groupBy("unit_id", "block").applyInPandas(keyed, "unit_id long, block long, h long, seq long, height long, base long, top long"), "put")
    end = put.filter("seq = -1").groupBy("unit_id").agg(F.max_by(F.struct("height", "base", "top"), "block").alias("end"))
    last = put.filter("seq >= 0").groupBy("unit_id", "h").agg(F.max_by("seq", "block").alias("seq"))
    done = last.join(end, "unit_id").filter("h > end.base and h <= end.height").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("h", "seq"))).alias("e"))
    out = end.join(done, "unit_id", "left")
    text = F.coalesce(F.array_join(F.transform("e", lambda x: x["seq"].cast("string")), ","), F.lit(""))
    return out.select("unit_id", (F.col("end.height") - F.col("end.base")).alias("n_done"), (F.col("end.top") - F.col("end.height")).alias("n_undone"), text.alias("done"))


def _starts(rows: DataFrame, depth: int) -> DataFrame:
    """(unit_id, block, height, base, top): the state in which each block of a long log starts."""
    every = _states(depth)

    def summary(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["seq", "event_type"])
        height, top = every.copy()
        base = np.zeros_like(height)
        _walk(part.event_type.map(KINDS).dropna().astype(int).to_numpy(), height, base, top, depth)
        return pd.DataFrame({"unit_id": [key[0]], "block": [key[1]], "table": [np.stack([height, base, top]).astype("<i8").tobytes()]})

    def tables(part: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(t, "<i8").reshape(3, -1) for t in part.table]

    def together(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        state = np.stack([every[0], np.zeros_like(every[0]), every[1]])
        for t in tables(part.sort_values("block")):
            state = _apply(t, state)
        return pd.DataFrame({"unit_id": [key[0]], "block": [key[1]], "table": [state.astype("<i8").tobytes()]})

    def down(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block").reset_index(drop=True)
        state, out = part[["height", "base", "top"]].iloc[0].to_numpy(np.int64), []
        for t in tables(part):
            out.append(state)
            state = _apply(t, state)
        return pd.concat([part[["unit_id", "block"]], pd.DataFrame(out, columns=["height", "base", "top"])], axis=1)

    kind = "unit_id long, block long, table binary"
    above = F.floor(F.col("block") / FAN)
    levels = [written(rows.groupBy("unit_id", "block").applyInPandas(summary, kind), "tables")]
    while levels[-1].agg(F.max("block")).first()[0] > 0:
        levels.append(written(levels[-1].groupBy("unit_id", above).applyInPandas(together, kind), "tables"))
    state = levels[-1].select("unit_id", "block", *[F.lit(0).cast("long").alias(c) for c in ("height", "base", "top")])
    for level in levels[-2::-1]:
        below = level.withColumn("_up", above).join(state.withColumnRenamed("block", "_up"), ["unit_id", "_up"])
        state = written(below.groupBy("unit_id", "_up").applyInPandas(down, "unit_id long, block long, height long, base long, top long"), "starts")
    return state


def stream_edit_fold(log: DataFrame, depth: int = DEPTH) -> DataFrame:
    """L2: the same as a stream; the two stacks are the state, a row a unit and batch is put out (update mode)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, undone = (list(x) for x in state.get) if state.exists else ([], [])
        _fold(pd.concat(list(parts)).sort_values("seq"), done, undone, depth)
        state.update((done, undone))
        yield _row(key[0], done, undone)

    return log.select("unit_id", "seq", "event_type").groupBy("unit_id").applyInPandasWithState(run, FOLDED, "done array<long>, undone array<long>", "update", GroupStateTimeout.NoTimeout)


def stream_firing_metrics(events: DataFrame, length: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """L1: spikes (unit_id, ts) by unit and tumbling or, with slide, sliding window: count, and mean and least interval
    between spikes of the window; rows later than the watermark are dropped. A window's times are one unit's spikes of
    that length, in the state of a stream until the watermark passes."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    t = F.array_sort(F.collect_list(F.unix_micros("ts")))
    w = events.withWatermark("ts", late).groupBy("unit_id", window.alias("w")).agg(t.alias("t"))
    n = F.size("t")
    gaps = F.zip_with(F.slice("t", F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice("t", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: x - y)
    mean = F.try_divide((F.element_at("t", -1) - F.element_at("t", 1)) / 1e6, n - 1)
    return w.select("unit_id", F.col("w.start").alias("start"), n.cast("long").alias("n"), mean.alias("mean_isi_s"), (F.array_min(gaps) / 1e6).alias("min_isi_s"))


def stream_isi(events: DataFrame) -> DataFrame:
    """L3: interval of each spike to the unit's last one, which is kept as state across batches."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("sample_idx")
        before = rows.sample_idx.shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((int(rows.sample_idx.iloc[-1]),))
        yield pd.DataFrame({"unit_id": rows.unit_id, "sample_idx": rows.sample_idx, "isi": (rows.sample_idx - before).astype("Int64")})

    return events.groupBy("unit_id").applyInPandasWithState(run, "unit_id long, sample_idx long, isi long", "last long", "append", GroupStateTimeout.NoTimeout)


def burst_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """L3: bursts, sessions of spikes at most `gap` apart, with their counts."""
    s = events.withWatermark("ts", late).groupBy("unit_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("unit_id", F.col("w.start").alias("start"), "n")


def stream_bursts(events: DataFrame, gap_ms: int = 1_800_000, late: str = "1 hour") -> DataFrame:
    """L3: bursts of a stream (unit_id, ts), put out once, when the watermark has passed the last spike by the gap: a timer
    closes a burst without further spikes of the unit, and a unit without open bursts has no state. Spikes of earlier
    batches may be joined by late ones; spikes behind the watermark are dropped by Spark."""
    gap = 1000 * gap_ms

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bursts = [list(x) for x in zip(*state.get)] if state.exists else []
        if not state.hasTimedOut:
            for part in parts:
                bursts += [[int(t), int(t), 1] for t in part["at"]]
        merged: list[list[int]] = []
        for b in sorted(bursts):
            if merged and b[0] - merged[-1][1] < gap:
                merged[-1][1] = max(merged[-1][1], b[1])
                merged[-1][2] += b[2]
            else:
                merged.append(b)
        passed = 1000 * state.getCurrentWatermarkMs()
        done, left = ([b for b in merged if (b[1] + gap <= passed) == closed] for closed in (True, False))
        if left:
            state.update(tuple(map(list, zip(*left))))
            state.setTimeoutTimestamp(max(min(b[1] for b in left) + gap, passed) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"unit_id": [key[0]] * len(done), "start": pd.to_datetime([b[0] for b in done], unit="us", utc=True), "n": [b[2] for b in done]})

    rows = events.withWatermark("ts", late).select("unit_id", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("unit_id").applyInPandasWithState(run, "unit_id long, start timestamp, n long", "starts array<long>, ends array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
