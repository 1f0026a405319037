"""Results of several tables, committed together; edited results and edit logs."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volley.sources.ranges import opened

_MANIFESTS = "_manifests"


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("recording_id", "port") if c in df.columns]


def _manifest(path: str) -> tuple[int, dict]:
    """Number and content of the last manifest; 0 and nothing if there is none."""
    fs, root = opened(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{_MANIFESTS}", allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.endswith(".json"))
    if not names:
        return 0, {}
    with fs.open_input_file(f"{root}/{_MANIFESTS}/{names[-1]}") as f:
        return int(names[-1][:-5]), json.loads(f.read())


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Tables by recording and port where they have them, committed together.

    Each table is written to a folder of its own under path; readers know nothing of it until, last of all, a manifest
    with the next number is put in place by a rename. Of a table written before, only the partitions that are written
    again are replaced; tables without such columns as a whole. A job that fails leaves the old result as it was, and
    folders that no manifest names. Two writers that commit at once are told apart by the number: the second is an error.
    """
    spark = next(iter(tables.values())).sparkSession
    number, old = _manifest(path)
    new = dict(old)
    for name, df in tables.items():
        keys, folder = _keys(df), f"{name}/{uuid.uuid4().hex}"
        (df.write.partitionBy(*keys) if keys else df.write).parquet(f"{path}/{folder}")
        parts = [list(r) for r in spark.read.schema(df.schema).parquet(f"{path}/{folder}").select(*keys).distinct().collect()] if keys else []
        kept = []
        for entry in old.get(name, []) if keys else []:
            left = [p for p in entry["parts"] if p not in parts]
            if left:
                kept.append(entry | {"parts": left})
        new[name] = [*kept, {"folder": folder, "keys": keys, "parts": parts, "schema": df.schema.json()}]
    fs, root = opened(path)
    fs.create_dir(f"{root}/{_MANIFESTS}", recursive=True)
    draft, final = f"{root}/{_MANIFESTS}/{uuid.uuid4().hex}.draft", f"{root}/{_MANIFESTS}/{number + 1:012d}.json"
    with fs.open_output_stream(draft) as f:
        f.write(json.dumps(new).encode())
    if fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
        raise RuntimeError(f"another writer has committed {final}")
    fs.move(draft, final)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the last commit: of each folder the partitions that still count."""
    entries = _manifest(path)[1].get(name)
    if not entries:
        raise FileNotFoundError(f"{path} has no table {name}")
    out = None
    for e in entries:
        schema = T.StructType.fromJson(json.loads(e["schema"]))
        df = spark.read.schema(schema).parquet(f"{path}/{e['folder']}")
        if e["keys"]:
            parts = spark.createDataFrame([tuple(p) for p in e["parts"]], T.StructType([schema[k] for k in e["keys"]]))
            same = [df[k].eqNullSafe(parts[k]) for k in e["keys"]]
            df = df.join(F.broadcast(parts), same, "left_semi")  # a row a partition, from the manifest
        df = df.select([f.name for f in schema])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


#: What an edited result takes over unchanged from the result it edits.
UNTOUCHED = "data aux_channels plateau_coords chans_per_electrode channel_indices emg_mask electrodes dewhitened_filters version preprocessing_config w_mat selected_points peel_off_sequence".split()


def edited_result(spikes: DataFrame, sources: DataFrame, units: DataFrame, history: DataFrame, spans: DataFrame, original: dict[str, DataFrame] | None = None, full: bool = True) -> dict[str, DataFrame]:
    """The tables of an edited result, for write_tables.

    spans: (recording_id or port where they exist, start, end), the plateau. With `full` (whole recordings are edited)
    spikes become relative to the plateau's start and sources longer than the plateau are cut to it, each numbered from
    0; else both stay. units keep notes, flags and properties; history is the edit log. Of the original, UNTOUCHED tables
    pass through and its filters are kept beside the edited ones.
    """
    if full:
        by = [c for c in _keys(spans) if c in spikes.columns]
        near = lambda df: df.join(F.broadcast(spans), by) if by else df.crossJoin(F.broadcast(spans))  # noqa: E731 a row a recording
        unit = [*_keys(sources), "unit_id"]
        size = sources.groupBy(*unit).agg(F.count("*").alias("_n"))
        inside = (F.col("sample_idx") >= F.col("start")) & (F.col("sample_idx") < F.col("end"))
        long = F.col("_n") > F.col("end") - F.col("start")
        at = F.when(long, F.col("sample_idx") - F.col("start")).otherwise(F.col("sample_idx"))
        sources = near(sources.join(size, unit)).filter(~long | inside).withColumn("sample_idx", at).select(*sources.columns)
        spikes = near(spikes).withColumn("sample_idx", F.col("sample_idx") - F.col("start")).select(*spikes.columns)
    out = {"spikes": spikes, "sources": sources, "units": units, "history": history}
    for name, df in (original or {}).items():
        if name in UNTOUCHED:
            out[name] = df
        elif name == "filters":
            out["filters_original"] = df
    return out


def log_entries(actions: DataFrame) -> DataFrame:
    """actions (unit, seq, event_type, before, after: sorted or unsorted arrays of samples) with samples_added and
    samples_removed, sorted, each sample once. An undo goes back, so what it adds is what the edit removed; an action
    without one of the arrays (a flag, a changed filter) adds and removes nothing."""

    def apart(a: Column, b: Column) -> Column:
        return F.coalesce(F.array_sort(F.array_except(a, b)), F.array().cast("array<long>"))

    undo = F.col("event_type") == "undo"
    before, after = F.when(undo, F.col("after")).otherwise(F.col("before")), F.when(undo, F.col("before")).otherwise(F.col("after"))
    return actions.withColumns({"samples_added": apart(after, before), "samples_removed": apart(before, after)}).drop("before", "after")
