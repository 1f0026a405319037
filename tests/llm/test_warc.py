import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from volley.llm import warc


def test_round_trip(spark, tmp_path):
    big = "<p>" + "é\n\r\nWARC/1.0\r\n" * 3000 + "</p>"
    rows = [(1, "http://a", big, "x"), (2, "u\nv", big, "x"), (7, None, "tiny", "x"), (3, "u", "tiny", "x"), (4, "u", None, "x"), (5, "u", "", "x"), (None, "u", "lone " * 400, "x"), (6, "u", "x" * 300000, "x"), (6, "u", "x" * 300000, "x"), (8, "u", "line\n" * 500, "x"), (9, "u", "\r\n\r\n" * 500, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path, chunk=1000).collect()
    by = {}
    for r in got:
        by.setdefault((r.record_id, r.record_type), []).append(r)
    last = [r for r in got if r.last]
    assert len(last) == len(rows)
    for r in last:
        if r.record_id == "6":
            continue
        html = next((h for i, _, h, _ in rows if str(i) == r.record_id or (i is None and r.record_id is None)), None) or ""
        if r.record_type == "revisit":
            assert r.record_id == "1" and r.refers_to == "2" and r.header_length == len(big.encode()) and r.header_digest == hashlib.sha1(big.encode()).hexdigest()
            continue
        parts = sorted(by[r.record_id, "response"], key=lambda x: x.chunk_no)
        assert b"".join(bytes(p.data) for p in parts) == html.encode() and [p.chunk_no for p in parts] == list(range(len(parts)))
        assert r.bytes_so_far == len(html.encode()) and r.sha1_so_far == hashlib.sha1(html.encode()).hexdigest() == r.header_digest
        assert max(len(p.data) for p in parts) <= 1000
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, warc.read_warc(spark, path, chunk=1000, lines=True).collect())) == sorted(map(key, got))
    assert sum(r.record_id == "6" and r.record_type == "response" for r in last) == 2  # repeated rows of the response
    warc.write_warc(df.limit(0), path + "0")
    assert warc.read_warc(spark, path + "0").collect() == []


def test_a_huge_line_is_read_in_bounded_memory(tmp_path):
    """50 MB without a line break: the parser never holds more than a chunk and a block."""
    import gzip
    import resource

    import pyarrow as pa

    piece, n = b"<p>x</p>" * 1250, 5000
    with gzip.open(tmp_path / "a.gz", "wb", 1) as f:
        f.write(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: %d\r\n\r\n" % (len(piece) * n))
        for _ in range(n):
            f.write(piece)
        f.write(b"\r\n\r\n")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sha, rows = hashlib.sha1(piece * n).hexdigest(), 0
    mid = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    names = pa.RecordBatch.from_arrays([pa.array([f"file:{tmp_path}/a.gz"])], ["path"])
    for batch in warc._from_files(iter([names]), 1 << 16, True):
        rows += batch.num_rows
        last = batch.to_pylist()[-1] if batch.num_rows else last
    assert rows == -(-len(piece) * n // (1 << 16)) and last["last"] and last["sha1_so_far"] == sha and last["bytes_so_far"] == len(piece) * n
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - max(before, mid) < 30_000


@pytest.mark.parametrize("data", [b"WARC/1.0\r\nWARC-Record-ID: <1>\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc", b"junk\r\n\r\n", b"WARC/1.0\r\nWARC-Ty"])
def test_damage_is_an_error(data):
    with pytest.raises(ValueError, match="damaged"):
        p = warc._Parser(100, True)
        p.take(data)
        p.end()


@given(st.lists(st.binary(max_size=40), max_size=6), st.integers(1, 9), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_any_cut_gives_the_same_records(payloads, step, chunk):
    data = b"".join(b"WARC/1.0\r\nWARC-Record-ID: <%d>\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(p), p) for k, p in enumerate(payloads))
    parser = warc._Parser(chunk, True)
    for a in range(0, len(data), step):
        parser.take(data[a : a + step])
    parser.end()
    out = {}
    for r in parser.rows:
        out.setdefault(int(r[0]), []).append(r[7])
    assert [b"".join(out[k]) for k in range(len(payloads))] == payloads and all(len(x) <= chunk for v in out.values() for x in v)
