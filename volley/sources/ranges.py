"""Arrays of files as long samples, read by byte ranges: one long file is read by many tasks."""

from __future__ import annotations

import ast
import struct
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SAMPLES = "recording_id string, kind string, channel int, sample_idx long, x double"
#: Bytes of a file that a task reads, and values of a batch.
RANGE, BATCH = 32 << 20, 1 << 16


@dataclass
class Matrix:
    """An array of a file: stored rows follow each other from byte `at` on, each of `cols` values of `dtype`."""

    kind: str
    at: int
    rows: int
    cols: int
    dtype: str
    rows_are_samples: bool
    pick: list[int]  # of the stored rows or columns that are channels, those wanted, in order
    scale: list[float] = field(default_factory=list)


@dataclass
class Piece(InputPartition):
    """Stored rows row to row_end, and of each of them the values col to col_end."""

    path: str
    name: str
    of: Matrix
    row: int
    row_end: int
    col: int
    col_end: int


def pieces(path: str, name: str, m: Matrix, size: int) -> Iterator[Piece]:
    """Ranges of about `size` bytes: whole rows where they are short, else parts of one row."""
    width = np.dtype(m.dtype).itemsize
    rows = range(m.rows) if m.rows_are_samples else m.pick
    if m.rows_are_samples or m.cols * width <= size and list(rows) == list(range(m.rows)):
        step = max(1, size // max(1, m.cols * width))
        for a in range(0, m.rows, step):
            yield Piece(path, name, m, a, min(m.rows, a + step), 0, m.cols)
        return
    step = max(1, size // width)
    for r in rows:
        for a in range(0, m.cols, step):
            yield Piece(path, name, m, r, r + 1, a, min(m.cols, a + step))


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def read_piece(p: Piece) -> Iterator[pa.RecordBatch]:
    m, dtype = p.of, np.dtype(p.of.dtype)
    fs, path = opened(p.path)
    with fs.open_input_file(path) as f:
        f.seek(m.at + (p.row * m.cols + p.col) * dtype.itemsize)
        n = (p.row_end - p.row) * m.cols if p.row_end - p.row > 1 else p.col_end - p.col
        x = np.frombuffer(f.read(n * dtype.itemsize), dtype)
    if len(x) < n:
        raise ValueError(f"{p.name} ends before its last sample")
    x = x.reshape(p.row_end - p.row, -1)
    for k, c in enumerate(m.pick):
        if not m.rows_are_samples and not p.row <= c < p.row_end:
            continue
        values = (x[:, c] if m.rows_are_samples else x[c - p.row]).astype(float) * (m.scale[k] if m.scale else 1.0)
        values, first = values.astype(np.float32).astype(float), p.row if m.rows_are_samples else p.col  # single precision
        for a in range(0, len(values), BATCH):
            part = values[a : a + BATCH]
            text = lambda s, n=len(part): pa.array([s] * n, pa.string())
            yield pa.RecordBatch.from_arrays([text(p.name), text(m.kind), pa.array(np.full(len(part), k, np.int32)), pa.array(first + a + np.arange(len(part))), pa.array(part)], ["recording_id", "kind", "channel", "sample_idx", "x"])


def oriented(kind: str, at: int, shape: tuple[int, ...], dtype: str, fortran: bool, spec: dict) -> Matrix:
    """A field's array: channels picks [start, end] or a list of the first axis, of two-dimensional arrays; then the
    orientation says which axis is that of the samples (auto: the longer one, the first of equals)."""
    if len(shape) < 2:
        return Matrix(kind, at, shape[0] if shape else 1, 1, dtype, True, [0])
    ch = spec.get("channels")
    pick = list(range(shape[0])) if ch is None else list(range(*slice(*ch).indices(shape[0]))) if len(ch) == 2 and ch[1] > ch[0] else [c % shape[0] for c in ch]
    mode = spec.get("orientation", "auto")
    if mode not in ("auto", "channels_first", "samples_first"):
        raise ValueError(f"orientation {mode!r} is not auto, channels_first or samples_first")
    first_is_channels = mode == "channels_first" or mode == "auto" and shape[1] > len(pick)
    if not first_is_channels and ch is not None:
        raise ValueError("channels picks from the first axis, which is that of the samples here")
    rows, cols = shape[::-1] if fortran else shape
    channels_are_rows = first_is_channels != fortran
    return Matrix(kind, at, rows, cols, dtype, not channels_are_rows, pick if first_is_channels else list(range(shape[1])))


def npy_header(f: BinaryIO) -> tuple[int, tuple[int, ...], str, bool]:
    """(byte of the first value, shape, dtype, column order) of an array file that starts here."""
    start = f.tell()
    magic = f.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    size = struct.unpack("<H", f.read(2))[0] if magic[6] == 1 else struct.unpack("<I", f.read(4))[0]
    head = ast.literal_eval(f.read(size).decode("latin1"))
    if "O" in head["descr"]:
        raise ValueError("arrays of objects are not read")
    return f.tell() - start, head["shape"], head["descr"], head["fortran_order"]


def _npy(f: BinaryIO, fields: dict, options: dict) -> Iterator[Matrix]:
    at, shape, dtype, fortran = npy_header(f)
    for kind, spec in fields.items():  # a file has one array, whatever the field
        yield oriented(kind, at, shape, dtype, fortran, spec)


def _npz(f: BinaryIO, fields: dict, options: dict) -> Iterator[Matrix]:
    """An archive of stored (not deflated) arrays: a field is its path or the first of its fallback keys that is there."""
    with zipfile.ZipFile(f) as z:
        there = {i.filename.removesuffix(".npy"): i for i in z.infolist()}
    for kind, spec in fields.items():
        key = next((k for k in [spec["path"], *spec.get("fallback_keys", [])] if k in there), None)
        if key is None:
            raise KeyError(f"none of {[spec['path'], *spec.get('fallback_keys', [])]} is in the file, which has {sorted(there)}")
        if there[key].compress_type != zipfile.ZIP_STORED:
            raise ValueError(f"{key} is compressed and has no byte ranges")
        f.seek(there[key].header_offset + 26)
        name, extra = struct.unpack("<HH", f.read(4))
        start = f.seek(there[key].header_offset + 30 + name + extra)
        at, shape, dtype, fortran = npy_header(f)
        yield oriented(kind, start + at, shape, dtype, fortran, spec)


def _whole(size: int, width: int, name: str) -> int:
    if size % width:
        raise ValueError(f"{name} ends within a sample")
    return size // width


def _raw(f: BinaryIO, fields: dict, options: dict) -> Iterator[Matrix]:
    n = int(options["n_channels"])
    yield Matrix("emg", 0, _whole(f.seek(0, 2), 4 * n, "the file"), n, "<f4", True, list(range(n)))


def _otb(f: BinaryIO, fields: dict, options: dict) -> Iterator[Matrix]:
    """An uncompressed tar of signals (.sig, of as many bits as described in .xml) and auxiliary streams (.sip)."""
    with tarfile.open(fileobj=f, mode="r:") as tar:
        files = {m.name: m for m in tar if m.isfile()}
        texts = {n: tar.extractfile(m).read() for n, m in files.items() if n.endswith(".xml")}
    for name in sorted(n for n in files if n.endswith(".sig")):
        root = ET.fromstring(texts[name[:-4] + ".xml"])
        device = (root.get("Name") or "").split(";")[0]
        if device != "QUATTROCENTO":
            raise ValueError(f"device {device!r} is not supported")
        n, bits = int(root.get("DeviceTotalChannels")), int(root.get("ad_bits"))
        adapters = [(int(a.get("ChannelStartIndex")), float(a.get("Gain"))) for a in root.iter("Adapter")]
        pick, scale = [], []
        for (a, gain), (z, _) in zip(adapters, adapters[1:]):  # the last adapter only ends the one before
            pick += range(a, z)
            scale += [5.0 * 1000 / (2**bits * gain)] * (z - a)
        if not pick:
            raise ValueError(f"{name} has no active adapter")
        yield Matrix("emg", files[name].offset_data, _whole(files[name].size, n * bits // 8, name), n, f"<i{bits // 8}", True, pick, scale)
    aux = [files[n] for n in sorted(files) if n.endswith(".sip")]
    for k, m in enumerate(aux):
        least = min(x.size // 8 for x in aux)
        yield Matrix(f"aux:{k}", m.offset_data, least, 1, "<f8", True, [0])


FORMATS = {"npy": _npy, "npz": _npz, "bin": _raw, "otb+": _otb}


def checked_layout(layout: dict) -> dict:
    """A layout: name, format and fields (kind -> path, fallback_keys, channels, orientation)."""
    missing = [k for k in ("name", "format", "fields") if k not in layout]
    if missing:
        raise ValueError(f"a layout needs name, format and fields; {missing} is missing")
    if layout["format"] not in FORMATS:
        raise ValueError(f"format {layout['format']} is not one of {sorted(FORMATS)}")
    return layout


class Recordings(DataSource):
    """spark.read.format("recordings").option("layout", ...).load(path): the files at or under path. The layout is that of
    checked_layout, as JSON; bytes is what a task reads."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(dict(self.options))


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        import json

        self.options, self.layout = options, checked_layout(json.loads(options["layout"]))

    def partitions(self) -> list[InputPartition]:
        """Only headers are read here."""
        fs, path = opened(self.options["path"])
        info = fs.get_file_info(path)
        files = [info] if info.is_file else [x for x in fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_"))]
        prefix = self.options["path"].removesuffix(path.lstrip("/")) if "://" in self.options["path"] else ""
        out: list[InputPartition] = []
        for x in sorted(files, key=lambda x: x.path):
            with fs.open_input_file(x.path) as f:
                for m in FORMATS[self.layout["format"]](f, self.layout["fields"], self.options):
                    out += pieces(prefix + (x.path.lstrip("/") if prefix else x.path), x.base_name, m, int(self.options.get("bytes", RANGE)))
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for batch in read_piece(partition):
            kind, _, number = partition.of.kind.partition(":")
            if number:  # a stream of its own is one channel
                n = batch.num_rows
                batch = batch.set_column(1, "kind", pa.array([kind] * n, pa.string())).set_column(2, "channel", pa.array(np.full(n, int(number), np.int32)))
            yield batch
