import gzip
import hashlib
import zlib

import pytest

from tablesmith.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


def test_round_trip(frame):
    big = "<p>" + "ü" * 300
    rows = [(3, "http://a", big, "x", 1), (1, "http://b\r\nX: y", big, "x", 1), (2, None, "short", "x", 1), (9, None, "short", None, None), (4, "u", None, "x", 1), (5, "u", "", "x", 1), (1, "http://b", big, "x", 1), (None, "u", big, "x", 1), (7, "u", "long " * 300_000, "x", 1)]
    pages = frame(rows, SCHEMA)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest_pages(pages).collect()), key=str)
    want = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        again = html == big and page == 3
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)
    payloads = {r.page_id: bytes(r.payload) for r in warc.read(warc.write(pages)).collect() if r.record_type == "response"}
    assert payloads[7].decode() == "long " * 300_000 and payloads[4] == b""
    assert warc.digest_pages(frame([], SCHEMA)).count() == 0


def test_archives_are_plain_gzip_members():
    data = b"".join(warc.encode(i, "http://x", f"page {i}".encode(), hashlib.sha256(f"page {i}".encode()).hexdigest(), None) for i in range(3))
    assert gzip.decompress(data).count(b"WARC/1.1") == 3
    assert [r["payload"] for r in warc.records(iter([data[:7], data[7:90], data[90:]]))] == [b"page 0", b"page 1", b"page 2"]


def test_damage_is_found():
    data = warc.encode(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    plain = gzip.decompress(data)
    for bad in (plain.replace(b"payload", b"paxload"), plain.replace(b"Content-Length: 8", b"Content-Length: 9")):
        if bad != plain:
            with pytest.raises(ValueError):
                list(warc.records(iter([gzip.compress(bad)])))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(iter([data[:-9]])))


def test_files_of_archives(spark, frame, tmp_path):
    pages = frame([(i, f"http://x/{i}", f"<p>page {i % 7}</p>" * 20, "x", 1) for i in range(40)], SCHEMA).coalesce(2)
    segments = {}
    for r in warc.write(pages).collect():
        segments.setdefault(r.archive, {})[r.segment] = bytes(r.data)
    for archive, parts in segments.items():
        (tmp_path / f"{archive}.warc.gz").write_bytes(b"".join(parts[i] for i in sorted(parts)))
    key = lambda df: sorted((r.page_id, r.record_type, r.payload_digest, r.refers_to) for r in df.collect())
    assert key(warc.read_files(spark, str(tmp_path))) == key(warc.digest_pages(pages)) and len(segments) >= 1
