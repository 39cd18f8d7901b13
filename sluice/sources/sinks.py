"""Ordered sinks for lines and bytes."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.encodings import NAMES, with_mark


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes inside go as each write ends, not when the driver's
    heap is next cleaned, so that they don't lie beside what is made of the parts."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ordered_parts(lines: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """The output's lines, empty ones left out, so that files in the order of
    their names hold them in order; sorted by range, not in one task."""
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.where("content <> ''").repartitionByRange(n, *order).sortWithinPartitions(*order).select("content")


def write_lines(lines: DataFrame, order: list[str], directory: str, partitions: int | None = None, mode: str = "overwrite") -> dict[str, int]:
    """A folder of part files in order; returns n_lines and n_chars written."""
    seen = Observation("written")
    out = ordered_parts(lines, order, partitions).observe(seen, F.count("*").alias("n_lines"), F.coalesce(F.sum(F.char_length("content")), F.lit(0)).alias("n_chars"))
    with shuffles_dropped(lines.sparkSession):
        out.write.mode(mode).option("lineSep", "\n").text(directory)
    return seen.get


def write_file(lines: DataFrame, order: list[str], path: str, encoding: str = "utf-8", partitions: int | None = None, append: bool = False) -> dict[str, int]:
    """One local file: parts are written by the executors next to it, then put
    together by the driver, which holds a buffer only. A mark is written once."""
    name = NAMES.get(encoding.lower(), encoding)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    parts = tempfile.mkdtemp(prefix=".parts-", dir=os.path.dirname(os.path.abspath(path)))
    try:
        counts = write_lines(lines, order, f"{parts}/out", partitions)
        with open(f"{parts}/joined", "wb") as out:
            if not append:
                out.write(with_mark(b"", name))
            for part in sorted(p for p in os.listdir(f"{parts}/out") if p.startswith("part-")):
                with open(f"{parts}/out/{part}", encoding="utf-8", newline="") as f:
                    while block := f.read(1 << 20):
                        out.write(block.encode("utf-8" if name == "utf-8-sig" else name, "replace"))
        if append:
            with open(path, "ab") as out, open(f"{parts}/joined", "rb") as f:
                shutil.copyfileobj(f, out)
        else:
            os.replace(f"{parts}/joined", path)
        return counts
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def write_bytes(spark: SparkSession, paths: list[str], path: str) -> int:
    """Files put after one another, in order; returns the bytes written. The driver
    copies from any of Hadoop's file systems and holds a buffer only, so that a
    file's size has no bound."""
    jvm, total = spark._jvm, 0
    out = jvm.java.io.FileOutputStream(os.path.abspath(path))
    try:
        for p in paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
            try:
                total += stream.transferTo(out)
            finally:
                stream.close()
    finally:
        out.close()
    return total
