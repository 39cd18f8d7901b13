"""Line operators on streams: filters run as they are; duplicates go within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import with_key
from ..operators.filters import filtered
from ..spec import DedupSpec, FilterSpec, TimestampSpec
from ..functions.timestamps import timestamp_of


def stream_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of text files as they arrive: path, content."""
    lines = spark.readStream.option("lineSep", "\n").text(directory)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\z", "").alias("content"))


def cleaned(lines: DataFrame, filters: FilterSpec, dedup: DedupSpec | None = None, times: TimestampSpec | None = None, within: str = "10 minutes") -> DataFrame:
    """Filtered lines; with dedup, one line of a key within the watermark. Lines
    without a timestamp take that of the epoch."""
    out = filtered(lines, filters)
    if dedup is None or dedup.key == "none":
        return out
    t = times or TimestampSpec()
    ts = F.coalesce(timestamp_of(F.col("content"), t.kind, t.column, t.delimiter, t.pattern, t.epoch_ms, t.honor_tz), F.timestamp_seconds(F.lit(0)))
    keyed = with_key(out.withColumn("ts", ts), dedup).withColumnRenamed("_key", "key")
    return keyed.withWatermark("ts", within).dropDuplicatesWithinWatermark(["key"])
