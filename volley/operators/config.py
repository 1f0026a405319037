"""Channel maps, masks, manifests and concatenation: small tables that decide what is read from the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volley.operators.trains import unit_of

# Letters, motions and the pattern of task names.
FINGERS = {"T": "Thumb", "I": "Index", "M": "Middle", "R": "Ring", "L": "Little"}
MOTIONS = {"ext": "Ext", "flex": "Flex"}
TASK = r"(?i)mvc-\d+(ext|flex)_fing-([TIMRL]+)"
# What a port of a session or a grid of a channel configuration has if nothing else is said.
PORT_DEFAULTS = {"name": "unnamed", "type": "unknown", "rows": 1, "cols": 1, "spacing_mm": 4.0, "enabled": True}
SESSION_DEFAULTS = {"input_dir": "", "output_dir": "", "aux_channels": "[]", "auto_save": True, "undo_levels": 50}
GRID_DEFAULTS = {"lowpass_hz": 4400, "lowpass_surface_hz": 500, "highpass_hz": 10, "sil_threshold": 0.85, "muap_window_ms": 20, "sampling_rate": 10240, "sampling_frequency": 2048}
GRID_DEFAULTS |= {"notch_filter": "None", "notch_harmonics": False, "iterations": 200, "clamp": True, "fitness": "CoV", "peel_off": True, "peel_off_repeats": True, "swarm": True, "loader": ".otb+"}
PARAMETERS = ["extension_factor", "lowpass_hz", "highpass_hz", "sil_threshold", "muap_window_ms", "notch_filter", "notch_harmonics", "iterations", "clamp", "fitness", "peel_off", "peel_off_repeats", "swarm"]


def select_channels(samples: DataFrame, spec: list[int] | None = None, as_range: bool | None = None) -> DataFrame:
    """None keeps all; two ascending numbers are a half-open range, anything else a list. Channels are renumbered
    in order from 0."""
    if spec is None:
        return samples
    if as_range if as_range is not None else len(spec) == 2 and spec[1] > spec[0]:
        return samples.filter((F.col("channel") >= spec[0]) & (F.col("channel") < spec[1])).withColumn("channel", F.col("channel") - spec[0])
    order = F.array(*[F.lit(c) for c in spec])
    return samples.filter(F.col("channel").isin(spec)).withColumn("channel", (F.array_position(order, F.col("channel")) - 1).cast("int"))


def orient(cells: DataFrame, mode: str = "auto") -> DataFrame:
    """Cells (i, j, x) -> (channel, sample_idx, x); auto: the longer axis is time, rows if equal."""
    if mode == "auto":
        size = cells.agg(F.max("i").alias("_i"), F.max("j").alias("_j"))
        rows = F.col("_i") >= F.col("_j")
        cells = cells.join(F.broadcast(size))
    else:
        rows = F.lit(mode == "samples_first")
    return cells.select(F.when(rows, F.col("j")).otherwise(F.col("i")).alias("channel"), F.when(rows, F.col("i")).otherwise(F.col("j")).alias("sample_idx"), "x")


def time_axis(samples: DataFrame, fs: float) -> DataFrame:
    """A9."""
    return samples.withColumn("t", F.col("sample_idx") / float(fs))


def load_sessions(text: DataFrame) -> DataFrame:
    """A10: rows (file, doc) of session documents in JSON -> a row an enabled port's channel: (file, session, fs, port,
    electrode, etype, local_idx, channel, rows, cols, spacing_mm), and of the session input_dir, output_dir, aux_channels
    (JSON), auto_save and undo_levels. What a document leaves out has its default."""
    d, of_session = PORT_DEFAULTS, SESSION_DEFAULTS
    told = lambda c, kind: F.coalesce(F.get_json_object("doc", f"$.{c}").try_cast(kind), F.lit(of_session[c])).alias(c)
    more = [told(c, k) for c, k in (("input_dir", "string"), ("output_dir", "string"), ("aux_channels", "string"), ("auto_save", "boolean"), ("undo_levels", "int"))]
    electrode = "struct<name:string,type:string,channels:array<int>,rows:int,cols:int,spacing_mm:double>"
    doc = F.from_json("doc", f"struct<name:string,sampling_frequency:double,ports:array<struct<name:string,enabled:boolean,electrode:{electrode}>>>")
    ports = text.select("file", doc.alias("d"), *more).select("file", *of_session, F.coalesce("d.name", F.lit(d["name"])).alias("session"), F.coalesce("d.sampling_frequency", F.lit(float(GRID_DEFAULTS["sampling_frequency"]))).alias("fs"), F.explode("d.ports").alias("p"))
    ports = ports.filter(F.coalesce("p.enabled", F.lit(d["enabled"])))
    e = lambda name: F.coalesce(f"p.electrode.{name}", F.lit(d[name]))
    return ports.select("file", "session", "fs", F.col("p.name").alias("port"), e("name").alias("electrode"), e("type").alias("etype"), F.posexplode("p.electrode.channels").alias("local_idx", "channel"), e("rows").alias("rows"), e("cols").alias("cols"), e("spacing_mm").alias("spacing_mm"), *of_session)


def load_channel_config(text: DataFrame, overrides: dict | None = None) -> DataFrame:
    """A10: rows (file, doc) of channel configurations in JSON (sampling_rate, grids: name, type, config, start_chan,
    end_chan; loader) -> a row a grid: (file, fs, loader, port, electrode, etype, start_chan, n_channels) and PARAMETERS, of
    which overrides replaces those it names. A grid without channels is left out."""
    d = GRID_DEFAULTS
    unknown = set(overrides or {}) - set(PARAMETERS)
    if unknown:
        raise ValueError(f"{sorted(unknown)} are not parameters")
    doc = F.from_json("doc", "struct<sampling_rate:double,loader:string,grids:array<struct<name:string,type:string,config:string,start_chan:int,end_chan:int>>>")
    g = text.select("file", doc.alias("d")).select("file", F.coalesce("d.sampling_rate", F.lit(float(d["sampling_rate"]))).alias("fs"), F.coalesce("d.loader", F.lit(d["loader"])).alias("loader"), F.explode("d.grids").alias("g")).select("file", "fs", "loader", "g.*")
    n = F.col("end_chan") - F.col("start_chan")
    surface = F.lower(F.coalesce("type", F.lit(""))) == "surface"
    g = g.filter(n > 0)
    values = {c: F.lit(d[c]) for c in PARAMETERS if c in d} | {"extension_factor": F.ceil(1000 / n), "lowpass_hz": F.when(surface, d["lowpass_surface_hz"]).otherwise(d["lowpass_hz"])}
    values |= {c: F.lit(v) for c, v in (overrides or {}).items()}
    return g.select(
        "file", "fs", "loader", F.col("name").alias("port"), F.coalesce("config", F.lit("")).alias("electrode"), F.when(surface, "surface_grid").otherwise("intramuscular").alias("etype"), "start_chan", n.alias("n_channels"),
        *[values[c].alias(c) for c in PARAMETERS],
    )


def _rejections(text: DataFrame) -> DataFrame:
    return text.select("file", F.explode(F.from_json("doc", "map<string,string>")).alias("port", "v"))


def parse_rejections(text: DataFrame, ports: DataFrame | None = None) -> DataFrame:
    """Rows (file, doc) of JSON, {port: [0/1...]} or {port: {channels, time_masks}} -> (file, port, channel,
    rejected). With ports (port, n_channels) every channel of every port has a row for each file; a mask of another
    length, or none, counts as all zeros."""
    flags = F.coalesce(F.from_json("v", "array<int>"), F.from_json(F.get_json_object("v", "$.channels"), "array<int>"))
    masks = _rejections(text).select("file", "port", flags.alias("flags"))
    if ports is not None:
        every = text.select("file").crossJoin(ports.select("port", F.col("n_channels").alias("n")))  # that is what is returned, whatever the masks
        masks = every.join(masks, ["file", "port"], "left").select("file", "port", F.when(F.size("flags") == F.col("n"), F.col("flags")).otherwise(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("flags"))
    return masks.select("file", "port", F.posexplode("flags").alias("channel", "r")).select("file", "port", "channel", (F.col("r") != 0).alias("rejected"))


def parse_time_masks(text: DataFrame) -> DataFrame:
    """The time masks of the same documents: (file, port, t0_s, t1_s)."""
    pairs = F.explode(F.from_json(F.get_json_object("v", "$.time_masks"), "array<array<double>>"))
    return _rejections(text).select("file", "port", pairs.alias("m")).select("file", "port", F.get("m", F.lit(0)).alias("t0_s"), F.get("m", F.lit(1)).alias("t1_s"))


def expand_manifest(manifest: DataFrame) -> DataFrame:
    """(subject, group, files) -> a row a file with run_name and its first place over all groups."""
    rows = manifest.select(F.concat_ws("_", F.regexp_replace("subject", "-", ""), "group").alias("run_name"), "group", F.posexplode("files").alias("place", "file"))
    return rows


def distinct_files(rows: DataFrame) -> DataFrame:
    """Distinct files in the order first seen (group, place), of each subject where there are several."""
    by = [c for c in ("subject",) if c in rows.columns]
    first = rows.groupBy(*by, "file").agg(F.min(F.struct("group", "place")).alias("_at"))
    return first.select(*by, "file", F.row_number().over(Window.partitionBy(*by).orderBy("_at")).alias("nr"))


def skip_inspected(files: DataFrame, saved: DataFrame) -> DataFrame:
    """A14."""
    return files.join(saved, "file", "left_anti")


def recording_info(samples: DataFrame, fs: float) -> DataFrame:
    """Samples, channels, seconds and the largest value of each recording."""
    return samples.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("n_samples"), F.count_distinct("channel").alias("n_channels"), ((F.max("sample_idx") + 1) / float(fs)).alias("seconds"), F.max("x").alias("mvc"))


def port_channels(samples: DataFrame, ports: DataFrame) -> DataFrame:
    """B1: samples of each port's channels (of its recording, where ports have one), with the local number."""
    return samples.join(ports, [*[c for c in ("recording_id",) if c in ports.columns], "channel"])


def missing_channels(samples: DataFrame, ports: DataFrame) -> DataFrame:
    """B1: ports' channels that no sample has."""
    return ports.join(samples.select("channel").distinct(), "channel", "left_anti")


def allocate_channels(grids: DataFrame, skip_quaternions: bool = True) -> DataFrame:
    """B2: (idx, n_channels, is_hd) -> start and end, one grid after the other (of a recording, where there are several), 6
    channels left free after an HD grid; an unknown size counts as 64."""
    by = [c for c in ("recording_id",) if c in grids.columns]
    n = F.coalesce("n_channels", F.lit(64))
    step = n + F.when(F.col("is_hd") & F.lit(skip_quaternions), 6).otherwise(0)
    start = F.coalesce(F.sum(step).over(Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return grids.withColumn("start", start).withColumn("end", start + n)


def validate_ranges(grids: DataFrame, most: int, width: int = 64) -> DataFrame:
    """(idx, problem): beyond (end > most), empty (start >= end), overlap (with an earlier grid). A range is spread to
    the stretches of `width` channels that it touches, so that overlapping ones meet by an equality."""
    last = F.greatest(F.col("end") - 1, F.col("start"))  # an empty range inside another one overlaps too
    spread = grids.select("idx", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))).alias("b"))
    first = spread.select("b", *[F.col(c).alias(f"_{c}") for c in ("idx", "start", "end")])
    over = spread.join(first, "b").filter("idx > _idx and start < _end and _start < end").select("idx", F.lit("overlap").alias("problem")).distinct()
    return grids.filter(F.col("end") > most).select("idx", F.lit("beyond").alias("problem")).unionByName(grids.filter("start >= end").select("idx", F.lit("empty").alias("problem"))).unionByName(over)


def grid_layout(channels: DataFrame, cols: int, spacing_mm: float = 8.0) -> DataFrame:
    """Active channels (port, local_idx, rejected) numbered again without the rejected; row and column of a regular
    grid by the original number; unmapped or rejected cells keep dense null."""
    w = Window.partitionBy("port").orderBy("local_idx")
    dense = F.when(~F.col("rejected"), F.sum((~F.col("rejected")).cast("int")).over(w) - 1)
    return channels.select("port", "local_idx", "rejected", F.floor(F.col("local_idx") / cols).cast("int").alias("row"), F.pmod(F.col("local_idx"), F.lit(cols)).alias("col"), dense.alias("dense_idx"))


def match_model(ports: DataFrame, models: DataFrame) -> DataFrame:
    """(port, electrode) with model: the first (by pos) of models (pos, model) whose key is contained in the
    electrode's name, in any case; null if none is. models is a table of known electrodes, a few rows."""
    hit = ports.join(F.broadcast(models), F.contains(F.lower("electrode"), F.lower("model")), "left")
    return hit.groupBy("port", "electrode").agg(F.min_by("model", "pos").alias("model"))


def map_to_grid(channels: DataFrame, positions: DataFrame) -> DataFrame:
    """Active channels (port, model, local_idx, rejected) on the positions (model, key, row, col) of an electrode of
    any shape: (port, local_idx, dense_idx, row, col). dense_idx counts the channels that aren't rejected; a channel
    without a position has nulls."""
    w = Window.partitionBy("port").orderBy("local_idx")
    live = channels.withColumn("dense_idx", F.when(~F.col("rejected"), F.sum((~F.col("rejected")).cast("int")).over(w) - 1))
    return live.join(positions.withColumnRenamed("key", "local_idx"), ["model", "local_idx"], "left").select("port", "local_idx", "dense_idx", "row", "col")


def crop_window(info: DataFrame, t0: float | None, t1: float | None, fs: float) -> DataFrame:
    """(recording_id, n_samples) -> start, stop: rounded half to even, ordered, clamped, at least a sample; no
    bounds or an empty span: the whole file."""
    a, z = (min(t0, t1), max(t0, t1)) if t0 is not None and t1 is not None else (t0 or 0.0, t1)
    if z is None or z <= a:
        return info.select("recording_id", F.lit(0).cast("long").alias("start"), F.col("n_samples").cast("long").alias("stop"))
    start = F.least(F.greatest(F.bround(F.lit(a * fs)).cast("long"), F.lit(0)), F.col("n_samples") - 1)
    stop = F.greatest(F.least(F.bround(F.lit(z * fs)).cast("long"), F.col("n_samples")), start + 1)
    return info.select("recording_id", start.alias("start"), stop.alias("stop"))


def to_local(spikes: DataFrame, start: int, stop: int) -> DataFrame:
    """Samples of a plateau, counted from its start."""
    return spikes.filter((F.col("sample_idx") >= start) & (F.col("sample_idx") < stop)).withColumn("sample_idx", F.col("sample_idx") - start)


def extract_aux(samples: DataFrame, aux: DataFrame) -> DataFrame:
    """Samples of each aux channel's range [start_chan, end_chan); bad ranges give none."""
    a = aux.filter("start_chan < end_chan").withColumn("channel", F.explode(F.sequence("start_chan", F.col("end_chan") - 1)))
    by = [c for c in ("recording_id",) if c in samples.columns and c in aux.columns]
    return samples.join(a.select(*by, "name", "channel"), [*by, "channel"]).select(*by, "name", "channel", "sample_idx", "x")


def file_offsets(lengths: DataFrame) -> DataFrame:
    """(group, file_id, n_samples) -> offset of each file on the group's common axis."""
    w = Window.partitionBy("group").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("offset", F.coalesce(F.sum("n_samples").over(w), F.lit(0)))


def concat_recordings(samples: DataFrame, offsets: DataFrame) -> DataFrame:
    """Samples of all files of a group on one axis."""
    return samples.join(offsets.select("group", "file_id", "offset"), "file_id").select("group", "channel", (F.col("sample_idx") + F.col("offset")).alias("sample_idx"), "x")


def offset_time_masks(masks: DataFrame, offsets: DataFrame, fs: float) -> DataFrame:
    """C2."""
    d = F.col("offset") / float(fs)
    return masks.join(offsets, "file_id").select("group", "file_id", (F.col("t0_s") + d).alias("t0_s"), (F.col("t1_s") + d).alias("t1_s"))


def or_masks(masks: DataFrame) -> DataFrame:
    """C3."""
    return masks.groupBy("port", "channel").agg(F.bool_or("rejected").alias("rejected"))


def inherited_masks(masks: DataFrame) -> DataFrame:
    """C4: for each file, channels rejected in any other file: the total less the own flag, no self join."""
    own = F.col("rejected").cast("int")
    total = masks.groupBy("port", "channel").agg(F.sum(own).alias("_all"))
    return masks.join(total, ["port", "channel"]).select("file_id", "port", "channel", (F.col("_all") - own > 0).alias("rejected"))


def mask_union_report(masks: DataFrame) -> DataFrame:
    """The rejected channels of each port over all files, ascending."""
    return masks.filter("rejected").groupBy("port").agg(F.array_join(F.array_sort(F.collect_set("channel")).cast("array<string>"), ",").alias("channels"))


def shared_masks(masks: DataFrame) -> DataFrame:
    """The first file's mask for every file."""
    first = masks.groupBy("port", "channel").agg(F.min_by("rejected", "file_id").alias("_first"))
    return masks.join(first, ["port", "channel"]).select("file_id", "port", "channel", F.col("_first").alias("rejected"))


def parse_task(names: DataFrame, mode: str = "strict") -> DataFrame:
    """(name) -> a row a finger and target, as in the unit labels. strict: of `mvc-<n><ext|flex>_fing-<letters>` in
    any case. lenient: the motion is ext, else flex, anywhere in the part after mvc- up to the next _, the letters those
    after fing- (this in lower case), each on its own if it names a finger."""
    if mode == "strict":
        move, letters = F.lower(F.regexp_extract("name", TASK, 1)), F.regexp_extract("name", TASK, 2)
    else:
        part = F.lower(F.regexp_extract("name", "(?i)mvc-([^_]+)", 1))
        move = F.when(part.contains("ext"), "ext").when(part.contains("flex"), "flex").otherwise("")
        letters = F.regexp_extract("name", "fing-([A-Za-z]+)", 1)
    fingers, motions = (F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) for table in (FINGERS, MOTIONS))
    rows = names.select("name", F.try_element_at(motions, move).alias("target"), F.explode(F.split(F.upper(letters), "")).alias("letter"))
    return rows.select("name", F.try_element_at(fingers, F.col("letter")).alias("finger"), "target").filter("finger is not null and target is not null")


#: Rows of aux channels of a task.
ROWS = 250_000


def select_aux_for_task(aux: DataFrame, tasks: DataFrame, mode: str = "strict") -> DataFrame:
    """The file's aux channels (file, unit) for its task. strict: those whose unit is a target (`Index Ext`), or all
    where none is. lenient: of the labelled ones those that contain a finger and the motion in any case; all labelled ones
    where none does or the task is unknown; all where none is labelled. Both tables are dealt once, by file, to as many tasks
    as the counted rows need, and join, windows and a later distinct stay there: a task's memory does not grow with the table."""
    parts = -(-aux.count() // ROWS) or 1
    aux, tasks = aux.repartition(parts, "file"), tasks.withColumn("file", F.col("name")).repartition(parts, "file")
    if mode == "strict":
        wanted = tasks.groupBy("file").agg(F.collect_set(F.concat_ws(" ", "finger", "target")).alias("_units"))  # five fingers, two motions at most
        hit, fall_back = aux.join(wanted, "file", "left").withColumn("_hit", F.array_contains("_units", F.col("unit"))).drop("_units"), F.lit(True)
    else:
        wanted = tasks.groupBy("file").agg(F.collect_set(F.lower("finger")).alias("_fingers"), F.min(F.lower("target")).alias("_target"))  # five fingers at most
        unit = F.lower(F.coalesce("unit", F.lit("")))
        hit = aux.join(wanted, "file", "left").withColumn("_hit", F.exists("_fingers", lambda f: F.contains(unit, f)) & F.contains(unit, F.col("_target"))).drop("_fingers", "_target")
        labelled = F.trim(unit) != ""
        fall_back = labelled | ~F.coalesce(F.max(labelled).over(Window.partitionBy("file")), F.lit(False))
    some = F.coalesce(F.max("_hit").over(Window.partitionBy("file")), F.lit(False))
    return hit.withColumns({"_some": some, "_back": fall_back}).filter("_hit or (not _some and _back)").drop("_hit", "_some", "_back")


def normalise_aux(aux: DataFrame, config: DataFrame) -> DataFrame:
    """mvc between 0 and 1 is in volts: times 1000; a missing one is taken from the config by name, then unit."""
    by_name = config.filter("name is not null").groupBy("name").agg(F.max("mvc").alias("_m1"))
    by_unit = config.filter("unit is not null").groupBy("unit").agg(F.max("mvc").alias("_m2"))
    out = aux.join(by_name, "name", "left").join(by_unit, "unit", "left")
    mvc = F.coalesce("mvc", "_m1", "_m2")
    return out.select("name", "unit", F.when((mvc > 0) & (mvc < 1), mvc * 1000).otherwise(mvc).alias("mvc"))


def restore_notes(units: DataFrame, saved: DataFrame) -> DataFrame:
    """F18."""
    key = unit_of(units)
    return units.join(saved, key, "left").select(*key, F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("notes", F.lit("")).alias("notes"))


def active_units(units: DataFrame, disabled: DataFrame) -> DataFrame:
    """B16."""
    return units.join(disabled, unit_of(units), "left_anti")
