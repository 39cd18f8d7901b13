import base64
import hashlib
import io

import pytest
import zstandard

from sluice.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload string"
PAGES = [
    (1, "http://a/", "same", None, None), (5, "http://b/\r\nX: y", "same", None, None), (3, None, "same", None, None), (7, "http://c/", None, None, None), (8, "http://c/", "", None, None),
    (9, "http://é/", "é" * 3000, None, None), (10, "", "a\r\n\r\nWARC/1.1\r\n\r\nb", None, None), (11, "u", "x" * 200000, None, None), (12, "u", "alone", None, None), (12, "u", "alone", None, None), (-4, "u", "neg", None, None),
]


def brute(pages):
    out = []
    for i, _, html, *_ in pages:
        data = (html or "").encode()
        top = max(j for j, _, h, *_ in pages if (h or "") == (html or ""))
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame, size", [(warc.FRAME_BYTES, warc.BUNDLE_BYTES), (1500, 1000), (1500, 10)])
def test_round_trip(spark, frame, size):
    df = spark.createDataFrame(PAGES, SCHEMA).repartition(2)
    bundles = warc.kept(warc.write_bundles(warc.pages_with_types(df), frame, size), "bundles")
    got = warc.read_bundles(bundles, with_payload=True).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(PAGES)
    html = {i: (h or "").encode() for i, _, h, *_ in PAGES}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")
    files = {r.bundle: bytes(r.content) for r in bundles.collect()}
    frames = 0
    for r in warc.index_of(bundles).collect():  # one ranged read of each record
        table = warc.read_seek_table(files[r.bundle])
        data = warc.read_frame(files[r.bundle], *table[r.frame])[r.offset : r.offset + r.length]
        headers, http, payload = warc.parse(data)
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and headers["warc-record-id"] == f"<urn:page:{r.page_id}>"
        assert payload == (html[r.page_id] if headers["warc-type"] == "response" else b"") and f"Content-Length: {len(html[r.page_id])}".encode() in http
        frames = max(frames, r.offset)
    assert frames > 0  # more records than one in a frame
    for content in files.values():  # any decoder reads the whole
        text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        assert len(text) == sum(whole for _, _, whole in warc.read_seek_table(content))
    assert sum(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(c), read_across_frames=True).read().count(b"WARC-Record-ID:") for c in files.values()) == len(PAGES)
    some = warc.read_records(bundles, spark.createDataFrame([(11,), (3,), (12,), (12,), (999,)], "page_id long")).collect()
    assert sorted((r.page_id, r.record_type, len(r.payload)) for r in some) == [(3, "revisit", 0), (11, "response", 200000), (12, "response", 5), (12, "response", 5)]


def test_exported_files(spark, tmp_path):
    bundles = warc.archive(spark.createDataFrame(PAGES, SCHEMA).repartition(2))
    assert warc.export(bundles, f"file://{tmp_path}") == bundles.count()
    assert {p.name: p.read_bytes() for p in tmp_path.glob("*.warc.zst")} == {r.bundle: bytes(r.content) for r in bundles.collect()}


def test_nulls_and_empty_table(spark):
    got = warc.read_bundles(warc.archive(spark.createDataFrame([(None, None, None, None, None), (2, None, None, None, None)], SCHEMA))).collect()
    assert sorted([(r.page_id, r.record_type, r.refers_to) for r in got], key=str) == sorted([(None, "revisit", 2), (2, "response", None)], key=str)
    assert warc.read_bundles(warc.archive(spark.createDataFrame([], SCHEMA))).count() == 0
