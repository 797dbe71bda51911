import gzip
import hashlib
import io

import pytest
from cases import prose

from pairrank.llm import warc

RESPONSE = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\nX-Page-Id: 7\r\n\r\nbody"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_arc_versions(version, packed):
    content = warc.write_arc("x.arc", version, "20260102030405", iter([("http://a/ b", RESPONSE), ("http://c", b"\n\nplain\n")]))
    records = list(warc.read_arc(gzip.compress(content) if packed else content))
    assert [f["URL"] for f, _ in records] == ["http://a/ b", "http://c"]
    assert [b for _, b in records] == [RESPONSE, b"\n\nplain\n"]
    row = warc.convert_record(*records[0])
    assert row[1:] == ("2026-01-02T03:04:05Z", "http://a/ b", "127.0.0.1", RESPONSE[:-4], b"body", 7, 200, "text/html")
    assert row[0] == warc.convert_record(*records[0])[0] != warc.convert_record(*records[1])[0]


def test_broken_archives():
    good = warc.write_arc("x.arc", 1, "20260102030405", iter([("u", RESPONSE)]))
    for bad in (good[:-10], b"not an archive 3\nabc\n", good.replace(b"1 0 pairrank", b"9 0 pairrank"), good[:20], b"filedesc://x no length\n"):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))
    assert list(warc.read_arc(b"")) == []


def pages():
    long, short = prose(1, 400), "short"
    return [(1, "http://a", long), (2, "http://b", long), (9, "http://c", long), (3, "http://d e\n", short), (4, None, short), (5, "http://f", None),
            (6, "http://g", ""), (7, "http://h", "é" * 600), (8, "http://h", "é" * 600), (8, "http://h", "é" * 600),
            (None, "http://i", prose(2, 300)), (10, "http://j", prose(2, 300)), (11, "http://k", "WARC/1.1\r\n\r\n" * 200)]


def test_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, content string").repartition(3)
    folder = warc.convert_archives(warc.archives(df), str(tmp_path / "warc"))
    got = warc.with_referred_key(warc.read_warc(spark, folder)).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, page in rows:
        data = (page or "").encode()
        largest[data] = max(largest.get(data, -1), -1 if i is None else i)
    want = []
    for i, _, page in rows:
        data = (page or "").encode()
        revisit = len(data) >= 1000 and (i is None or i != largest[data])
        want.append((i or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[data] if revisit else None,
                     None if revisit else data))
    found = [(r.key or 0, r.payload_bytes, r.digest, r.type, r.refers_to_key, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    urls = {r.key: r.url for r in got}
    assert urls[3] == "http://d%20e%0A" and urls[4] == warc.NO_URL


def test_a_changed_payload_is_found():
    record = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:0\r\n"
              b"WARC-Block-Digest: sha1:0\r\nContent-Type: text/html\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n")
    (read,) = warc.read_records(io.BytesIO(record))
    assert read[1] == b"body"
    with pytest.raises(ValueError):
        warc.described(*read)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(record[:-8])))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    folder = warc.convert_archives(warc.archives(none), str(tmp_path / "none"))
    assert warc.read_warc(spark, folder).count() == 0
