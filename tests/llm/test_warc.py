import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from lockstep.llm.common import new_path
from lockstep.llm.warc import coalesced, make_record, parse_record, read_records, write_archive


@pytest.mark.parametrize("payload", [b"", b"plain", b"a\r\n\r\nb\r\n\r\n", "é你".encode() * 1000])
def test_record_round_trip(payload):
    record, digest = make_record(7, "http://x/a b\r\nc", payload, None)
    assert digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    back = parse_record(record)
    assert (back["page_id"], back["payload"], back["record_type"], back["refers_to"]) == (7, payload, "response", None)
    assert back["url"] == "http://x/a%20b%0D%0Ac"
    revisit = parse_record(make_record(None, None, payload, 9)[0])
    assert (revisit["page_id"], revisit["payload"], revisit["payload_bytes"], revisit["refers_to"]) == (None, None, len(payload), 9)
    with pytest.raises(ValueError):
        parse_record(record[:-1])


def test_coalesced_reads():
    ranges = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 5), ("b", 0, 60), ("b", 60, 60)]
    got = list(coalesced(ranges, gap=5, most=100))
    assert got == [("a", 0, 30, [(0, 10), (10, 10), (25, 5)]), ("a", 100, 5, [(100, 5)]), ("b", 0, 60, [(0, 60)]), ("b", 60, 60, [(60, 60)])]
    assert list(coalesced([])) == []


def expected(rows, min_bytes=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        known = [i for i in ids if i is not None]
        keeper = max(known) if known and len(ids) > 1 and len(payload) >= min_bytes else None
        for i in ids:
            refers = keeper if keeper is not None and i != keeper else None
            out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "<p>x"), (2, None, "<p>x"), (3, "http://b/\n", None), (4, "u", ""), (5, "u", "é" * 100_000), (6, "u", "one"), (6, "u", "one"), (None, "u", "one"), (None, "v", "two"), (None, "v", "two")]


@pytest.mark.parametrize("min_bytes,file_bytes", [(0, 1 << 20), (4, 300)])
def test_archive_round_trip(spark, min_bytes, file_bytes):
    pages = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, digest string")
    folder = new_path(spark, "warc-test")
    index = write_archive(pages, folder, min_bytes, file_bytes)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_records(index, folder).collect()]
    assert sorted(got, key=str) == expected(ROWS, min_bytes)
    assert index.where("url = 'http://a/'").count() == 1
    some = read_records(index.where(F.col("page_id") == 5), folder).collect()
    assert [bytes(r.payload) for r in some] == ["é".encode() * 100_000]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = new_path(spark, "warc-none")
    assert read_records(write_archive(pages, folder), folder).count() == 0
