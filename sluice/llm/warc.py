"""WARC records in seekable Zstandard bundles.

A bundle is a file: records are grouped into independent Zstandard frames of
about FRAME_BYTES, each readable alone, then comes a skippable frame with the
seek table (compressed and decompressed size of each frame, in the public
seekable format), which standard decoders skip. The index maps a record's id to
its bundle, its frame, and the offset and length of the record in that frame's
content, so that one record is read with one ranged read of its frame.
Everything is read back by this index: all records (read_bundles) or some by
their ids (read_records).

Bundles are rows of a table in the shared folder, which executors write and
read without a path of their own; export() copies them out as .warc.zst files.

Records of equal payload digests: the one with the largest id is the response,
the others are revisits that refer to it and hold no payload. Which one that is
comes from a partially aggregated maximum by digest, joined back against a
table in the shared folder, so a payload shared by most pages does not land in
one task. Bundles are cut by bytes; a very long record has a frame, and one
above the size of a bundle a bundle, of its own, and its memory is in
proportion to it.

Null payloads count as empty. Rows that repeat an id repeat its record; of equal
payloads with the largest id all are responses. Null ids are written as records
without a page and never a response to others unless no id is there. Extra
columns of any name are not read. No rows: no bundles, and no rows read back.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, kept

#: Bytes of records after which a frame ends, and compressed bytes after which a bundle does.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 4_000_000
#: Magic numbers of the skippable frame and of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"  # records are equal from run to run


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str | None) -> str:
    """A value that fits on a header's line."""
    return re.sub(r"[\r\n]+", " ", text or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with the payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "none" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_value(url)}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's headers by lower-case name, its HTTP header and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", a, b) for a, b in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and decompressed size of each frame."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8  # with checksums
    at, out, start = len(bundle) - 9 - n * width, [], 0
    for k in range(n):
        size, whole = struct.unpack_from("<II", bundle, at + k * width)
        out.append((start, size, whole))
        start += size
    return out


def read_frame(bundle: bytes, start: int, size: int, whole: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + size], max_output_size=max(1, whole)) if size else b""


def pages_with_types(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to and revisit for each row of df."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    first = kept(pages.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "digests")
    both = pages.join(first.drop("n"), "digest", "left")
    revisit = F.coalesce(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    return both.select("page_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


#: Where a record is in its bundle: its frame, and its bytes in the frame's content.
PLACES = "array<struct<page_id:long,frame:int,offset:long,length:long>>"


def write_bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """pages: of pages_with_types. One row per bundle: bundle (its file's name),
    content, and records: page_id, frame, and the record's offset and length in it."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3, write_content_size=True)
        open_, frames, sizes, records, size = bytearray(), [], [], [], 0

        def bundle() -> pa.RecordBatch:
            content = b"".join(frames) + seek_table(sizes)
            name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([records], kind)], names=["bundle", "content", "records"])

        def close_frame() -> int:
            frames.append(pack.compress(bytes(open_)))
            sizes.append((len(frames[-1]), len(open_)))
            open_.clear()
            return len(frames[-1])

        for batch in batches:
            for row in zip(*batch.columns):
                data = record(*(x.as_py() for x in row))
                records.append({"page_id": row[0].as_py(), "frame": len(frames), "offset": len(open_), "length": len(data)})
                open_ += data
                if len(open_) >= frame_bytes:
                    size += close_frame()
                if size >= bundle_bytes:
                    yield bundle()
                    frames, sizes, records, size = [], [], [], 0
        if open_:
            close_frame()
        if frames:
            yield bundle()

    kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
    return pages.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(run, f"bundle string, content binary, records {PLACES}")


def index_of(bundles: DataFrame) -> DataFrame:
    """Where each record is: page_id, bundle, frame, offset, length."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.page_id", "bundle", "r.frame", "r.offset", "r.length")


def read_bundles(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record that the column records names, read from the bundles'
    bytes by its frame, offset and length: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to. A response's size and digest are
    those of the payload read; a revisit's are those of its headers."""

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def read(data: bytes, page_id: int | None) -> tuple:
        headers, http, payload = parse(data)
        said, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if number(headers["warc-record-id"]) != page_id or kind == "response" and (digest_of(payload) != said or len(payload) != length):
            raise ValueError(f"record {headers['warc-record-id']} is damaged")
        return page_id, headers["warc-target-uri"], length, said, kind, number(headers.get("warc-refers-to")), payload

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(*batch.columns):
                bundle = content.as_py()
                table, by_frame = read_seek_table(bundle), {}
                for r in places.as_py():
                    by_frame.setdefault(r["frame"], []).append(r)
                for frame, records in by_frame.items():
                    data = read_frame(bundle, *table[frame])
                    rows = [read(data[r["offset"] : r["offset"] + r["length"]], r["page_id"]) for r in records]
                    columns = [*zip(*rows)][: 6 + with_payload]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return bundles.select("content", "records").mapInArrow(run, schema)


def read_records(bundles: DataFrame, wanted: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the ids in wanted (column page_id), as read_bundles gives
    them. Only frames that hold one are decompressed."""
    found = index_of(bundles).join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    places = found.groupBy("bundle").agg(F.collect_list(F.struct("page_id", "frame", "offset", "length")).alias("records"))  # a bundle's, at most
    return read_bundles(bundles.select("bundle", "content").dropDuplicates(["bundle"]).join(places, "bundle"), with_payload)


def export(bundles: DataFrame, directory: str) -> int:
    """Writes bundles as files into a folder of any of Hadoop's file systems, one
    at a time through the driver; returns how many there are."""
    spark, n = bundles.sparkSession, 0
    paths = spark._jvm.org.apache.hadoop.fs
    for row in bundles.select("bundle", "content").toLocalIterator():
        at = paths.Path(directory, row.bundle)
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(row.content))
        finally:
            out.close()
        n += 1
    return n


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes df's pages as bundles, a table in the shared folder, and returns it."""
    return kept(write_bundles(pages_with_types(df, id_col, url_col, payload_col, min_bytes)), "bundles")
