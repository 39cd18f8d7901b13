"""Line and byte scans. The table of lines: file_idx, path, line_no (from 1,
header and blank lines counted) and content.

Files are split by Spark. Line numbers come from the number of lines in the
splits before, so lines are not shuffled by file; what is joined back is one row
per split.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encodings import Counts, counts_of, decoded, mark_of, named

LINES = "file_idx int, path string, line_no bigint, content string"
#: Line feeds of encodings of 2 and 4 bytes, as text of so many
#: characters. UTF-32's other order has one that overlaps itself, which Hadoop's
#: reader misses at the end of a buffer.
FEEDS = {"utf-16-le": "\n\0", "utf-16-be": "\0\n", "utf-32-le": "\n\0\0\0"}
#: Bytes of a file in them that is decoded whole; longer ones are split.
WHOLE = 4 << 20
#: Files up to which what is known of each, or of its splits, is broadcast to the lines.
MANY = 100_000


def _hidden(path: str) -> bool:
    return os.path.basename(path)[:1] in ("_", ".")


def _small(df: DataFrame, files: int) -> DataFrame:
    return F.broadcast(df) if files <= MANY else df


def numbered_splits(lines: DataFrame, files: int) -> DataFrame:
    """lines of so many files: path, split, mid (increasing), content. Adds line_no."""
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split")) - F.col("n")
    offsets = splits.select("path", "split", (before - F.col("first") + 1).alias("offset"))
    return lines.join(_small(offsets, files), ["path", "split"]).select("path", (F.col("mid") + F.col("offset")).alias("line_no"), "content")


def _records(spark: SparkSession, paths: list[str], feed: str) -> DataFrame:
    """Records of files between feeds: path, split, mid (increasing) and content,
    raw bytes in a string."""
    return spark.read.option("lineSep", feed).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("mid"), F.col("value").alias("content")
    )


def _wide_lines(spark: SparkSession, paths: list[str], feed: str) -> DataFrame:
    """path, line_no and content (raw) of files whose characters have len(feed)
    bytes or more, by splits. A feed's bytes can also stand across two characters
    (U+0A05 before U+4E00): only files that have such a place, told by a record of
    a length that is no multiple, are put together again, split by split."""
    width = len(feed)

    def read(some: list[str]) -> DataFrame:
        """The reader takes three bytes for UTF-8's mark that are none here."""
        cut = [p for p in some if head_of(spark, p, 3) == b"\xef\xbb\xbf"]
        raw = _records(spark, some, feed)
        if not cut:
            return raw
        firsts = raw.where((F.col("split") == 0) & plain_path(F.col("path")).isin([_full(p) for p in cut])).groupBy("path").agg(F.min("mid").alias("mid"))
        raw = raw.join(F.broadcast(firsts.withColumn("mark", F.lit("\ufeff"))), ["path", "mid"], "left")
        return raw.select("path", "split", "mid", F.concat(F.coalesce("mark", F.lit("")), "content").alias("content"))

    odd = F.octet_length("content") % width
    across = {r[0] for r in read(paths).where(odd != 0).select(plain_path(F.col("path"))).distinct().collect()}
    aligned, others = [p for p in paths if _full(p) not in across], [p for p in paths if _full(p) in across]
    tables = [numbered_splits(read(aligned), len(aligned))] if aligned else []
    if others:
        raw = read(others)
        turns = raw.groupBy("path", "split").agg(F.sum(odd).alias("turn"))
        before = F.sum("turn").over(Window.partitionBy("path").orderBy("split")) - F.col("turn")
        own = Window.partitionBy("path", "split").orderBy("mid")
        placed = raw.join(_small(turns.select("path", "split", before.alias("before")), len(others)), ["path", "split"])
        # A record that starts at a character's start is a line's first.
        placed = placed.withColumn("first", ((F.col("before") + F.sum(odd).over(own) - odd) % width == 0).cast("long"))
        firsts = placed.groupBy("path", "split").agg(F.sum("first").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("path").orderBy("split")) - F.col("n")
        numbered = placed.join(_small(firsts.select("path", "split", upto.alias("upto")), len(others)), ["path", "split"]).withColumn("line_no", F.col("upto") + F.sum("first").over(own))
        pieces = F.array_sort(F.collect_list(F.struct("split", "mid", "content")))
        tables.append(numbered.groupBy("path", "line_no").agg(F.array_join(F.transform(pieces, lambda x: x["content"]), feed).alias("content")))
    return tables[0].union(tables[1]) if len(tables) > 1 else tables[0]


def scan_lines(spark: SparkSession, paths: list[str], encoding: str = "utf-8", keep_cr: bool = False) -> DataFrame:
    """Lines of files in the order of paths. Only \\n ends a line; one \\r before
    it goes. Files are split; decoded whole before are hidden ones, those in UTF-16
    and UTF-32 of at most WHOLE bytes, and those in encodings other than FEEDS and
    ASCII's supersets here. A byte order mark is dropped."""
    shown = [p for p in paths if not _hidden(p)]
    name = named(encoding) or encoding
    if name in ("utf-8", "ascii", "latin-1", "gbk", "big5", "utf-8-sig") and len(shown) == len(paths) and paths:
        lines = numbered_splits(_records(spark, shown, "\n"), len(shown))
        content = F.col("content") if name in ("utf-8", "ascii", "utf-8-sig") else decoded(F.col("content").cast("binary"), name)
    else:
        long = [p for p in shown if name in FEEDS and size_of(spark, p) > WHOLE]
        files = scan_bytes(spark, [p for p in paths if p not in long])
        text = decoded(F.col("content"), name)
        # A file is split once, inside the generator: beside it, each line would split its file again.
        whole = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
        lines = files.where(F.octet_length("content") > 0).select("path", F.posexplode(whole).alias("at", "content")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "content")
        if long:
            wide = _wide_lines(spark, long, FEEDS[name]).select("path", "line_no", decoded(F.col("content").cast("binary"), name).alias("content"))
            lines = lines.union(wide) if len(long) < len(paths) else wide
        content = F.col("content")
    content = F.when(F.col("line_no") == 1, F.regexp_replace(content, "^\ufeff", "")).otherwise(content)
    content = content if keep_cr else F.regexp_replace(content, r"\r\z", "")
    return _with_index(spark, lines.select("path", "line_no", content.alias("content")), paths)


def _full(path: str) -> str:
    """A path as plain_path has it."""
    return os.path.abspath(path) if "://" not in path else path


def _with_index(spark: SparkSession, lines: DataFrame, paths: list[str]) -> DataFrame:
    names = spark.createDataFrame([(k, p, _full(p)) for k, p in enumerate(paths)], "file_idx int, given string, full string")
    return lines.withColumn("full", plain_path(F.col("path"))).join(_small(names, len(paths)), "full").select("file_idx", F.col("given").alias("path"), "line_no", "content")


def plain_path(uri: Column) -> Column:
    """The path of a local file's URI; others stay."""
    escaped = F.replace(F.regexp_replace(uri, "^file:/+", "/"), F.lit("+"), F.lit("%2B"))
    return F.when(uri.startswith("file:"), F.try_url_decode(escaped)).otherwise(uri)


def scan_bytes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and content of whole files. Hidden names, which Spark's listings
    skip, are read by the executors themselves (local or mounted folders only)."""
    shown, hidden = [p for p in paths if not _hidden(p)], [p for p in paths if _hidden(p)]
    out = spark.createDataFrame([], "path string, content binary")
    if shown:
        out = spark.read.format("binaryFile").load(shown).select(plain_path(F.col("_metadata.file_path")).alias("path"), "content")
    if hidden:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    with open(p, "rb") as f:
                        yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([f.read()], pa.binary())], names=["path", "content"])

        listed = spark.createDataFrame([(os.path.abspath(p),) for p in hidden], "path string")
        out = out.union(listed.mapInArrow(read, "path string, content binary"))
    return out


def head_of(spark: SparkSession, path: str, size: int = 65536) -> bytes:
    """The first bytes of a file, through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def size_of(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()


def byte_counts(spark: SparkSession, paths: list[str]) -> dict[str, Counts]:
    """The counts of all bytes of each file, for its encoding. Splits are counted
    by the executors; what the driver adds up is one row per split."""
    shown, hidden = [p for p in paths if not _hidden(p)], [p for p in paths if _hidden(p)]

    def row(path: str, split: int, c: Counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": path, "split": split, "size": c.size, "even": c.zeros[0], "odd": c.zeros[1], "control": c.control, "utf8": c.utf8, "high": c.high, "good": c.good}])

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sum_ = None, Counts()
        for batch in batches:
            places, lines = [*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], batch.column(2).to_pylist()
            start = 0
            while start < len(places):
                end = start + 1
                while end < len(places) and places[end] == places[start]:
                    end += 1
                if at != places[start]:
                    if at:
                        yield row(*at, sum_)
                    at, sum_ = places[start], Counts()
                sum_ = sum_.then(counts_of(b"\n".join(lines[start:end]) + b"\n"))
                start = end
        if at:
            yield row(*at, sum_)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                sum_ = Counts()
                with open(p, "rb") as f:
                    while lines := f.readlines(1 << 24):
                        sum_ = sum_.then(counts_of(b"".join(lines)))
                yield row(p, 0, sum_)

    kind = "path string, split long, size long, even long, odd long, control long, utf8 boolean, high long, good long"
    tables = []
    if shown:
        raw = spark.read.option("lineSep", "\n").text(shown)
        tables.append(raw.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary")).mapInArrow(splits, kind))
    if hidden:
        tables.append(spark.createDataFrame([(os.path.abspath(p),) for p in hidden], "path string").mapInArrow(files, kind))
    found: dict[str, Counts] = {}
    for r in sorted((r for t in tables for r in t.collect()), key=lambda r: (r.path, r.split)):
        found[r.path] = found.get(r.path, Counts()).then(Counts(r["size"], (r.even, r.odd), r.control, r.utf8, r.high, r.good))
    # The last line may have had no line feed, so sizes are the file system's.
    return {p: replace(found.get(_full(p), Counts()), size=size_of(spark, p)) for p in paths}


def lines_of(df: DataFrame, key: Column, text: Column, file_idx: int = 0, path: str = "") -> DataFrame:
    """Rows as lines of one file: line_no is the rank of key, a number from 1."""
    return df.select(F.lit(file_idx).alias("file_idx"), F.lit(path).alias("path"), key.cast("long").alias("line_no"), text.alias("content"))


def with_header_mark(lines: DataFrame, headed: set[int]) -> DataFrame:
    """Adds is_header: the first line of the files (by file_idx) in headed."""
    marks = F.col("file_idx").isin(sorted(headed)) if headed else F.lit(False)
    return lines.withColumn("is_header", marks & (F.col("line_no") == 1))


__all__ = ["LINES", "byte_counts", "head_of", "lines_of", "mark_of", "scan_bytes", "scan_lines", "with_header_mark"]
