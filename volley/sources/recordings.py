"""Recordings in, result tables out. Files are read by byte ranges, so a long one is many tasks' work."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volley.functions.scratch import written
from volley.sources.ranges import FORMATS, Recordings


def read_recordings(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """All files under path as long samples; recording_id is the file's name. An unknown format is an error.
    Options: orientation, channels, n_channels (bin) and bytes, what a task reads."""
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is not one of {sorted([*FORMATS, 'csv'])}")
    spec = {"path": "emg"} | {k: options.pop(k) for k in ("orientation", "channels") if k in options}
    return read_layout(spark, path, {"name": fmt, "format": fmt, "fields": {"emg": spec}}, **options)


def read_layout(spark: SparkSession, path: str, layout: dict, **options) -> DataFrame:
    """A1: the fields of a layout (name, format, fields: kind -> path, fallback_keys, channels, orientation)."""
    spark.dataSource.register(Recordings)
    return spark.read.format("recordings").options(layout=json.dumps(layout), **options).load(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A5: rows are samples, columns channels; the order of rows is that of the file. Spark splits long files: the number of
    a row is its place in its split and the rows of the splits before, of which there is a row each."""
    line = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("recording_id"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("line"))
    splits = line.groupBy("recording_id", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("recording_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = written(splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "splits")
    at = (F.col("_id") - F.col("_first") + F.col("_before")).alias("sample_idx")
    lines = line.join(splits, ["recording_id", "_at"]).select("recording_id", at, "line")
    cells = lines.select("recording_id", "sample_idx", F.posexplode(F.split("line", ",")).alias("channel", "v"))
    return cells.select("recording_id", F.lit("emg").alias("kind"), "channel", "sample_idx", F.expr("try_cast(v as double)").alias("x"))
