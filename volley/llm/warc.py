"""WARC archives: written by Spark's text writer, read back as a table of payload chunks.

An archive part is one gzip file, which a single task streams from the start in blocks of bytes; the reader holds one
block, one chunk, a running digest and the record's header, never a whole record or line, whatever a payload's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volley.llm.shared import join_small, materialize, unused

CRLF = "\r\n"
CHUNK_BYTES, BLOCK_BYTES = 1 << 20, 1 << 18
#: Bytes that a record's header has at most.
HEADER_BYTES = 1 << 20


def mark_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to (null: a response of its own).

    Of equal payloads (equal length, SHA-1 and MD5, the bytes themselves aren't compared) of at least `least` bytes the
    largest page_id is the response; its repeated rows are responses too. Only digests are grouped, with partial sums;
    payloads don't move.
    """
    pages = pages.drop("payload_bytes", "payload_digest", "refers_to").withColumn("html", F.coalesce("html", F.lit("")))
    second, keep = unused(pages, "second", "keep")
    pages = pages.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary")), second: F.md5(F.col("html").cast("binary"))})
    key = ["payload_digest", "payload_bytes", second]
    groups = pages.filter(F.col("payload_bytes") >= least).groupBy(*key).agg(F.max("page_id").alias(keep), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1").drop("n"), "revisits")
    pages = join_small(pages, groups, key, "left")
    return pages.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col(keep)), F.col(keep))).drop(keep, second)


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 1000) -> None:
    """One record a row: a response with the payload, or a revisit that names the response. Null html is an empty
    payload, a null url gives no target, a null page_id an id without a number."""

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def urn(c: str) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    p = mark_revisits(pages, least)
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("WARC/1.0" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("refers_to")), line("X-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    value = F.concat(head, F.when(revisit, "").otherwise(F.col("html")))
    p.select(value.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


SCHEMA = "record_id string, record_type string, target string, refers_to string, header_digest string, header_length long, chunk_no long, data binary, bytes_so_far long, sha1_so_far string, last boolean"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("header_digest", pa.string()), ("header_length", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_())])


class _Parser:
    """Takes an archive in pieces of any size; rows: the chunks that are complete."""

    def __init__(self, chunk: int, with_data: bool):
        self.chunk, self.with_data, self.rows = chunk, with_data, []
        self.head: dict[str, str] = {}
        self.left = 0  # of the payload
        self.text = b""  # what has come of the next header

    def take(self, data: bytes) -> None:
        at = 0
        while at < len(data):
            if self.left:
                piece = data[at : at + min(self.left, self.chunk - self.size)]
                at += len(piece)
                self._feed(piece)
            else:
                self.text, at = (self.text + data[at:]).lstrip(b"\r\n"), len(data)
                end = self.text.find(b"\r\n\r\n")
                if end >= 0:
                    data, at, head, self.text = self.text, end + 4, self.text[:end], b""
                    self._begin(head)
                elif len(self.text) > HEADER_BYTES:
                    raise ValueError("the archive is damaged: a header has no end")

    def end(self) -> None:
        if self.left or self.text:
            raise ValueError("the archive is damaged: it ends within a record")

    def _begin(self, head: bytes) -> None:
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("the archive is damaged: a record doesn't begin with WARC/")
        self.head = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}
        self.left, self.number, self.held, self.size, self.sha, self.done = int(self.head["content-length"]), 0, [], 0, hashlib.sha1(), 0
        if self.left == 0:
            self._emit(True)

    def _feed(self, piece: bytes) -> None:
        self.sha.update(piece)
        self.left -= len(piece)
        self.done += len(piece)
        self.size += len(piece)
        if self.with_data:
            self.held.append(piece)
        if self.left == 0 or self.size >= self.chunk:
            self._emit(self.left == 0)

    def _emit(self, last: bool) -> None:
        h = self.head
        length = h.get("x-payload-length")
        bare = lambda x: None if x is None else x.strip("<>").removeprefix("urn:page:") or None
        self.rows.append((bare(h["warc-record-id"]), h["warc-type"], h.get("warc-target-uri"), bare(h.get("warc-refers-to")), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None if length is None else int(length), self.number, b"".join(self.held) if self.with_data else None, self.done, self.sha.hexdigest(), last))
        self.number, self.held, self.size = self.number + 1, [], 0

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def read_warc(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES, with_data: bool = True, lines: bool | None = None) -> DataFrame:
    """Rows (record, chunk number) of all archives under path, with the count and SHA-1 of the payload so far; the row
    marked last has those of the whole payload. data concatenated by chunk_no is the payload.

    Archives are read in blocks of BLOCK_BYTES. In a store that only Spark can open (or with `lines`) they are read by
    Spark's text reader, which holds one line at a time. An archive that is cut off or has something else where a record
    should begin is an error; a folder without archives gives no rows.
    """
    if lines is None:
        try:
            _opened(path)
            lines = False
        except Exception:  # whatever this store's name makes of it
            lines = True
    if lines:
        text = spark.read.text(path, lineSep="\n").select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
        return text.mapInArrow(lambda batches: _from_lines(batches, chunk, with_data), SCHEMA)
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path")
    return files.mapInArrow(lambda batches: _from_files(batches, chunk, with_data), SCHEMA)


def _from_files(batches: Iterator[pa.RecordBatch], chunk: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column(0).to_pylist():
            store, at = _opened(name)
            parser, held = _Parser(chunk, with_data), 0
            with store.open_input_stream(at, compression="gzip" if at.endswith(".gz") else None) as stream:
                while block := stream.read(BLOCK_BYTES):
                    parser.take(block)
                    held += len(block)
                    if held > 4 * chunk or len(parser.rows) > 5000:
                        yield parser.batch()
                        held = 0
            parser.end()
            yield parser.batch()


def _from_lines(batches: Iterator[pa.RecordBatch], chunk: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    file, parser, held = None, _Parser(chunk, with_data), 0
    for batch in batches:
        for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != file:
                parser.end()
                file = name
            parser.take(value + b"\n")
            held += len(value)
            if held > 4 * chunk or len(parser.rows) > 5000:
                yield parser.batch()
                held = 0
    parser.end()
    yield parser.batch()
