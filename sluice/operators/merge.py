"""Combining lines: sequential, interleaved and timestamp order, and bytes.

Each operator gives the lines their place in the output as columns o1, o2, o3,
and numbered() turns places into one sequence without a single-task sort.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timestamps import timestamp_of
from ..sources.shared import kept
from ..spec import MergeSpec, TimestampSpec
from .dedup import deduplicated
from .filters import condition

ORDER = ["o1", "o2", "o3"]
#: Lines of a file that carry a timestamp forward within one task.
BLOCK = 100_000
#: Estimated bytes of a table that is numbered in one task.
SMALL = 1 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The size that Spark expects of df, from its sources' sizes; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def numbered(df: DataFrame, order: list[str], name: str = "seq", partitions: int | None = None) -> DataFrame:
    """Adds the rank of each row in the order, from 1: rows are range-partitioned
    and sorted, and a partition starts after the rows of those before it. They
    are kept in the shared folder in between, since ranges are drawn by sampling
    and must not be drawn twice. What Spark estimates at SMALL bytes at most is
    numbered in one task, and nothing is written."""
    if estimated_bytes(df) <= SMALL:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = kept(placed.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "numbered")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")  # one row per partition
    offsets = counts.select(F.col("_p").alias("_q"), (before - F.col("_first") + 1).alias("_o"))
    return placed.join(offsets, F.col("_p") == F.col("_q")).withColumn(name, (F.col("_m") + F.col("_o")).cast("long")).drop("_p", "_m", "_q", "_o")


def one_header(lines: DataFrame, show: bool = True) -> DataFrame:
    """Of the header lines, only that of the first file stays, or none."""
    first = F.col("is_header") & (F.col("file_idx") == 0) if show else F.lit(False)
    return lines.where(~F.col("is_header") | first)


def check_headers(headers: list[str | None]) -> None:
    """Warns where files have headers unlike the first one's."""
    for k, h in enumerate(headers[1:], 1):
        if (h is None) != (headers[0] is None):
            warnings.warn(f"file {k}: header present in some files only", stacklevel=2)
        elif h is not None and len(h.split(",")) != len(headers[0].split(",")):
            warnings.warn(f"file {k}: another number of columns in the header", stacklevel=2)
        elif h != headers[0]:
            warnings.warn(f"file {k}: other names in the header", stacklevel=2)


def sequential(lines: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return lines.withColumns({"o1": F.col("file_idx").cast("long"), "o2": F.col("line_no"), "o3": zero})


def interleaved(lines: DataFrame, chunk: int = 1) -> DataFrame:
    """Rounds of chunk lines of each file; headers and lines that are filtered
    later take their slots too."""
    if chunk < 1:
        raise ValueError("chunk must be 1 or more")
    at = F.col("line_no") - 1
    return lines.withColumns({"o1": F.expr(f"(line_no - 1) div {chunk}"), "o2": F.col("file_idx").cast("long"), "o3": at % chunk})


def carried_forward(lines: DataFrame, column: str = "ts") -> DataFrame:
    """Adds eff_ts: the last non-null of column up to each line of its file. Long
    files are done in blocks, each starting from the last value of those before."""
    blocked = lines.withColumn("_b", F.expr(f"(line_no - 1) div {BLOCK}"))
    ends = blocked.groupBy("file_idx", "_b").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("line_no"))).alias("_end"))
    upto = Window.partitionBy("file_idx").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("file_idx", "_b", F.last("_end", ignorenulls=True).over(upto).alias("_start"))
    inside = F.last(column, ignorenulls=True).over(Window.partitionBy("file_idx", "_b").orderBy("line_no"))
    return blocked.join(starts, ["file_idx", "_b"]).withColumn("eff_ts", F.coalesce(inside, "_start")).drop("_b", "_start")


def timestamp_sorted(lines: DataFrame, spec: TimestampSpec | None = None) -> DataFrame:
    """By timestamp, then file and line. Lines without one follow the line before
    them in their file; those before any timestamp come first."""
    spec = spec or TimestampSpec()
    ts = timestamp_of(F.col("content"), spec.kind, spec.column, spec.delimiter, spec.pattern, spec.epoch_ms, spec.honor_tz)
    placed = carried_forward(lines.withColumn("ts", ts))
    millis = F.coalesce(F.unix_millis("eff_ts"), F.lit(-(1 << 62)).cast("long"))
    return placed.withColumns({"o1": millis, "o2": F.col("file_idx").cast("long"), "o3": F.col("line_no")})


def merged(lines: DataFrame, spec: MergeSpec) -> DataFrame:
    """lines (with is_header) in the spec's mode, filtered, then without
    duplicates in the order of the output. Headers are neither filtered nor
    compared; in timestamp order there are none."""
    if spec.mode == "timestamp":
        placed = timestamp_sorted(lines.withColumn("is_header", F.lit(False)), spec.timestamp)
    elif spec.mode == "interleaved":
        placed = one_header(interleaved(lines, spec.chunk), spec.header)
    else:
        placed = one_header(sequential(lines), spec.header)
    rows = placed.where(F.col("is_header") | condition(F.col("content"), spec.filter, spec.compat))
    if spec.dedup.key == "none":
        return rows
    body = deduplicated(rows.where(~F.col("is_header")), spec.dedup, ORDER, compat=spec.compat)
    return body.union(rows.where("is_header"))


def binary_parts(files: DataFrame, paths: list[str]) -> DataFrame:
    """Whole files in the order of paths: seq, path, content, n_bytes, crc32."""
    order = F.array_position(F.array(*map(F.lit, paths)), F.regexp_replace("path", "^file:/+", "/"))
    return files.select(order.alias("seq"), "path", "content", F.octet_length("content").cast("long").alias("n_bytes"), F.crc32("content").alias("crc32"))


def byte_totals(files: DataFrame, chunk: int = 65536) -> DataFrame:
    """One row: files, bytes and chunks of chunk bytes."""
    size = F.octet_length("content").cast("long")
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.sum(F.ceil(size / chunk)), F.lit(0)).cast("long").alias("n_chunks"))


def same_content(files: DataFrame, left: str, right: str) -> DataFrame:
    """One row: whether two files of a byte scan have the same bytes, by length
    and SHA-256, without bringing them to one place."""
    digests = files.where(F.col("path").isin(left, right)).select("path", F.octet_length("content").alias("n"), F.sha2("content", 256).alias("h"))
    return digests.agg((F.count_distinct("path") == len({left, right})).alias("found"), (F.count_distinct("n", "h") == 1).alias("same"))
