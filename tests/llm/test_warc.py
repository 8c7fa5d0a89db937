import gzip
from io import BytesIO

import pytest
from quillspace.llm import warc as w


def archive(*blocks):
    return b"".join(w.member({"WARC-Type": "response", "WARC-Block-Digest": f"sha1:{w.digest(b)}"}, b) for b in blocks)


class Slow(BytesIO):
    def read(self, n=-1):
        return super().read(7)


def test_records_come_back_in_order_from_any_chunks():
    blocks = [b"", b"\r\n\r\n", b"x" * 100_000, "é\0".encode()]
    raw = archive(*blocks[:2]) + b"\0\0" + archive(*blocks[2:]) + b"\0"
    for stream in (BytesIO(raw), Slow(raw)):
        got = list(w.read_archive(stream))
        assert [r.block for r in got] == blocks
        for r in got:
            assert raw[r.start : r.start + 2] == b"\x1f\x8b"
    assert gzip.decompress(archive(b"abc")).endswith(b"abc\r\n\r\n")
    assert list(w.read_archive(BytesIO(b""))) == []


@pytest.mark.parametrize("raw", [archive(b"abc")[:-5], b"no gzip", gzip.compress(b"plain"), gzip.compress(b"WARC/1.1\r\nA: b\r\n\r\nabc\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Block-Digest: sha1:X\r\n\r\nabc\r\n\r\n")])
def test_broken_archives_are_errors(raw):
    with pytest.raises(w.WarcError):
        list(w.read_archive(BytesIO(raw)))


def test_round_trip_with_revisits(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u r\n:l", None), (4, "u", ""), (5, "u", "é" * 50_000), (5, "u", "é" * 50_000), (None, "u", "same"), (9, "u", "same")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, refers_to int")
    path = w.shared_path(spark, "warc-test")
    w.write_archives(pages, path)
    got = w.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    seen = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert seen == {(1, "revisit", 9), (2, "revisit", 9), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "response", None), (9, "response", None)}
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), w.digest(html.encode()))
        assert r["payload"] == (None if r["record_type"] == "revisit" else html.encode())
    path = w.shared_path(spark, "warc-test")
    w.write_archives(pages.limit(0), path)
    assert w.read_archives(spark, path).count() == 0
