"""WARC archives: exact round trips and the records' form."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from ticketlab.llm import warc as W


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, min_bytes=0):
    out = []
    for page, _, html in rows:
        size = len((html or "").encode())
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same and size >= min_bytes else None
        revisit = first is not None and first != page
        out.append((page, size, digest(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "<html>one</html>"), (2, "http://a/2", "<html>one</html>"), (3, None, None), (4, "http://a/ é\r\nWARC/1.1", ""),
    (5, "http://a/5", "x" * 100_000), (6, "u", "é中" * 30_000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (7, "u", "WARC/1.1"), (8, "u", "WARC/1.1\r\n"),
    (9, "u", "\r\n\r\n"), (10, "u", "a\r\n\r\n"), (11, "u", "WARC/1.WARC/1.1WARC/1.1"), (12, "u", "x" * 100_000), (None, "u", "<html>one</html>"), (None, "u", "only null"),
    (None, "u", "only null"), (13, "u", "twice"), (13, "u", "twice"), (13, "u", "thrice " * 9000), (13, "u", "thrice " * 9000), (-4, "u", "negative"), (14, "u", "negative"),
]


def round_trip(spark, rows, path, **kw):
    W.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, **kw)
    return sorted((tuple(r) for r in W.read_records(spark, path).collect()), key=str)


@pytest.mark.parametrize("chunk", [5, 1000, 64 << 10])
def test_round_trip(spark, tmp_path, chunk):
    rows = [r for r in ROWS if chunk > 5 or len(r[2] or "") < 1000]
    assert round_trip(spark, rows, f"{tmp_path}/a", chunk_bytes=chunk) == brute(rows)


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    assert round_trip(spark, ROWS, f"{tmp_path}/a", min_bytes=17) == brute(ROWS, 17)


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, [], f"{tmp_path}/a") == []


def test_chunks_carry_the_payload_and_running_digests(spark, tmp_path):
    html = "é" * 5000
    W.write_archive(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), f"{tmp_path}/a", chunk_bytes=999)
    rows = sorted(W.read_chunks(spark, f"{tmp_path}/a").collect(), key=lambda r: r.chunk)
    assert len(rows) > 10 and all(len(r.payload) <= 999 for r in rows)
    assert b"".join(bytes(r.payload) for r in rows).decode() == html
    running = hashlib.sha1()
    for r in rows:
        running.update(bytes(r.payload))
        assert r.so_far == "sha1:" + base64.b32encode(running.digest()).decode() and r.stated_digest == f"sha1:{digest(html)}"
    assert [r.last for r in rows] == [False] * (len(rows) - 1) + [True] and {r.type for r in rows[1:]} == {"continuation"}


def test_records_parse_by_content_length(spark, tmp_path):
    """A plain reader that only trusts Content-Length finds the same records."""
    W.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"), f"{tmp_path}/a", chunk_bytes=4096)
    found = {}
    for f in Path(f"{tmp_path}/a").glob("part-*.gz"):
        data, at = gzip.decompress(f.read_bytes()), 0
        while at < len(data):
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            field = dict(x.split(": ", 1) for x in lines[1:])
            block = data[at + len(head) + 4: at + len(head) + 4 + int(field["Content-Length"])]
            at += len(head) + 4 + len(block)
            assert data[at: at + 4] == b"\r\n\r\n"
            at += 4
            if field["WARC-Type"] == "response":
                block = block.partition(b"\r\n\r\n")[2]
            if field["WARC-Type"] != "revisit":
                found.setdefault(field.get("WARC-Segment-Origin-ID", field["WARC-Record-ID"]), {})[int(field.get("WARC-Segment-Number", 1))] = block
    payloads = {b"".join(c[i] for i in sorted(c)) for c in found.values()}
    assert payloads == {(h or "").encode() for _, _, h in ROWS}


def test_damage_is_noticed(spark, tmp_path):
    W.write_archive(spark.createDataFrame([(1, "u", "abc" * 1000)], "page_id long, url string, html string"), f"{tmp_path}/a", chunk_bytes=500)
    f = next(Path(f"{tmp_path}/a").glob("part-*.gz"))
    whole = gzip.decompress(f.read_bytes())
    f.write_bytes(gzip.compress(whole.replace(b"abcabcabc", b"abcabXabc", 1)))
    (Path(f"{tmp_path}/a") / f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="damaged"):
        W.read_records(spark, f"{tmp_path}/a").collect()


def test_first_task_without_rows_leaves_no_file(spark, tmp_path):
    """One row of four partitions stands in the last one."""
    W.write_archive(spark.createDataFrame([(1, "u", "abc" * 1000)], "page_id long, url string, html string"), f"{tmp_path}/a", chunk_bytes=500)
    files = list(Path(f"{tmp_path}/a").glob("part-*.gz"))
    assert len(files) == 1 and gzip.decompress(files[0].read_bytes())
    assert [r.payload_bytes for r in W.read_records(spark, f"{tmp_path}/a").collect()] == [3000]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_archive(none, f"{tmp_path}/none")
    assert W.read_records(spark, f"{tmp_path}/none").collect() == []
