"""Archives: round trip, dictionary frame, revisits."""

import io
import struct

import pytest
import zstandard

from aqspark.llm import warc

PAGES = [(1, "http://a", "<p>same</p>" * 30), (2, "http://b", "<p>same</p>" * 30), (3, "http://c\r\nx: y", None), (4, None, ""), (5, "u", "é" * 1000),
         (5, "u", "é" * 1000), (None, "n", "<p>same</p>" * 30), (None, "m", "alone"), (9, "z", "WARC/1.1\r\n\r\n")]


def test_archive_frames():
    records = [warc.record(str(k), "u", b"payload %d " % k * 50, warc.base32_sha1(b"payload %d " % k * 50), None) for k in range(300)]
    raw = b"".join(warc.archive(records))
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and zstandard.ZstdCompressionDict(raw[8 : 8 + size]).dict_id() != 0
    assert list(warc.read_archive(io.BytesIO(raw))) == records
    assert len(raw) < sum(map(len, records)) / 4 + size
    with pytest.raises(Exception):
        list(warc.read_archive(io.BytesIO(raw[:-5])))


@pytest.mark.parametrize("size", [1 << 24, 500])
def test_round_trip(spark, tmp_path, size):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, payload_bytes int").repartition(2)
    folder = f"file://{tmp_path}/archives"
    out = warc.read(warc.write(df, folder, archive_bytes=size), folder).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        same = [p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None]
        first = min(same, default=None)
        revisit = first is not None and i != first
        want.append((i, len(raw), warc.base32_sha1(raw), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert {r.page_id: bytes(r.payload) for r in out if r.record_type == "response"}[9] == b"WARC/1.1\r\n\r\n"


def test_small_payloads_and_empty(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/a"
    kinds = {r.page_id: r.record_type for r in warc.read(warc.write(df, folder, min_bytes=10), folder).collect()}
    assert kinds[3] == kinds[4] == "response" and kinds[2] == "revisit"
    assert warc.read(warc.write(df.limit(0), f"file://{tmp_path}/b"), f"file://{tmp_path}/b").count() == 0
