"""Merging files by a MergeSpec: expand, profile, scan, combine and write."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encodings import judged, mark_of, named
from ..functions.sniff import Profile, profile_bytes
from ..operators import join as joins
from ..operators import merge
from ..operators.dedup import deduplicated
from ..operators.filters import condition
from ..sources import sinks
from ..sources.files import expand_inputs, is_uri
from ..sources.lines import byte_counts, head_of, scan_bytes, scan_lines, size_of, with_header_mark
from ..spec import MergeSpec

#: First bytes that format, delimiter and header are told by.
HEAD = 65536
#: Files whose first bytes are read at once.
READERS = 16


class MergeError(ValueError):
    """Inputs that can't be merged as asked."""


def profiles(spark: SparkSession, paths: list[str], compat: str = "documented") -> list[Profile]:
    """Format, delimiter and header from the first bytes of each file; encodings
    from all bytes, in one job over the files that are longer."""
    with ThreadPoolExecutor(READERS) as pool:
        heads = [*pool.map(lambda p: head_of(spark, p, HEAD), paths)]
    long = [p for p, head in zip(paths, heads) if len(head) == HEAD and not mark_of(head)]
    counts = byte_counts(spark, long) if long else {}
    known = [judged(counts[p]) if p in counts else None for p in paths]
    return [profile_bytes(head, os.path.basename(p), compat, len(head) < HEAD, k) for p, head, k in zip(paths, heads, known)]


def profile(spark: SparkSession, path: str, compat: str = "documented") -> Profile:
    return profiles(spark, [path], compat)[0]


def profiles_table(spark: SparkSession, paths: list[str], compat: str = "documented") -> DataFrame:
    """One row per file: path, size, format, confidence, delimiter, has_header, width, encoding."""
    rows = []
    for path, p in zip(paths, profiles(spark, paths, compat)):
        rows.append((path, size_of(spark, path), p.format, p.confidence, p.delimiter, p.has_header, p.width, p.encoding))
    return spark.createDataFrame(rows, "path string, size long, format string, confidence double, delimiter string, has_header boolean, width int, encoding string")


def _scan(spark: SparkSession, paths: list[str], found: list[Profile], spec: MergeSpec) -> DataFrame:
    """All files' lines; files of one encoding are one scan."""
    of = [named(spec.source_encoding) or spec.source_encoding if spec.source_encoding != "auto" else p.encoding for p in found]
    of = ["utf-8" if e in ("ascii", "utf-8-sig") else e for e in of]
    tables = []
    for encoding in sorted(set(of)):
        own = [k for k, e in enumerate(of) if e == encoding]
        lines = scan_lines(spark, [paths[k] for k in own], encoding)
        places = F.array(*map(F.lit, own))
        tables.append(lines.withColumn("file_idx", F.get(places, F.col("file_idx"))))
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _expanded(spark: SparkSession, inputs: list[str], spec: MergeSpec, output: str | None) -> list[str]:
    paths = expand_inputs(inputs, spec.recursive, spec.pattern, output, spark)
    if not paths:
        raise MergeError("no input files")
    return paths


def merge_files(spark: SparkSession, inputs: list[str], spec: MergeSpec, output: str | None = None) -> DataFrame:
    """The merged lines, with their places o1, o2, o3 (binary: whole files, each a
    row, so of less than 2 GB; merge_to_file copies files of any size)."""
    paths = _expanded(spark, inputs, spec, output)
    if spec.mode == "binary":
        return merge.binary_parts(scan_bytes(spark, paths), [p if is_uri(p) else os.path.abspath(p) for p in paths])
    found = profiles(spark, paths, spec.compat)
    if spec.mode == "conditional":
        return _joined(spark, paths, found, spec)
    lines = _scan(spark, paths, found, spec)
    if spec.mode != "timestamp":
        merge.check_headers([",".join(p.header) if p.has_header else None for p in found])
    return merge.merged(with_header_mark(lines, {k for k, p in enumerate(found) if p.has_header}), spec)


def _as_bytes(text: str, encoding: str = "utf-8") -> str:
    """A text's bytes in an encoding as the characters of Latin-1."""
    return text.encode(named(encoding) or encoding, "replace").decode("latin-1")


def _joined(spark: SparkSession, paths: list[str], found: list[Profile], spec: MergeSpec) -> DataFrame:
    if len(paths) < 2:
        raise MergeError("a join needs two files")
    observed = spec.compat == "observed"
    if observed:  # bytes pass through: each is a character on the way
        found = [replace(p, header=[_as_bytes(x, p.encoding) for x in p.header], encoding="latin-1") for p in found]
        lines = replace(spec.filter, include=tuple(map(_as_bytes, spec.filter.include)), exclude=tuple(map(_as_bytes, spec.filter.exclude)), comment_prefix=_as_bytes(spec.filter.comment_prefix))
        spec = replace(spec, source_encoding="latin-1", filter=lines, key=_as_bytes(spec.key) if isinstance(spec.key, str) else spec.key)
    rows, keys = [], []
    for k in (0, 1):
        lines = _scan(spark, [paths[k]], [found[k]], spec).where(F.col("line_no") > int(found[k].has_header))
        rows.append(joins.rows_of(lines, found[k].delimiter))
        keys.append(joins.key_index(spec.key, found[k].header))
    if observed and rows[1].isEmpty():
        raise MergeError("the second file has no rows")
    how = "right_anti" if observed and spec.join_type == "right" else spec.join_type
    out = joins.joined_lines(joins.joined(*rows, *keys, how, found[0].width, found[1].width, keyless=not observed), spec.delimiter)
    out = out.where(condition(F.col("content"), spec.filter, spec.compat))
    out = deduplicated(out, spec.dedup, merge.ORDER, compat=spec.compat)
    if spec.header and found[0].has_header:
        head = spark.range(1).select(F.lit(-1).cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"), F.lit(0).cast("long").alias("o3"), joins.combined_header(found[0].header, found[1].header, spec.delimiter).alias("content"))
        out = head.union(out.select("o1", "o2", "o3", "content"))
    return out


def merge_to_file(spark: SparkSession, inputs: list[str], spec: MergeSpec, output: str, progress: Callable[[str], None] | None = None) -> dict[str, int]:
    """Writes the merge as one file; returns what was written. progress is told
    when the inputs are planned and when the output is written."""
    tell = progress or (lambda _: None)
    if spec.mode == "binary":
        paths = _expanded(spark, inputs, spec, output)
        tell("planned")
        counts = {"n_bytes": sinks.write_bytes(spark, paths, output)}
    else:
        out = merge_files(spark, inputs, spec, output)
        tell("planned")
        counts = sinks.write_file(out, merge.ORDER, output, "latin-1" if spec.mode == "conditional" and spec.compat == "observed" else spec.target_encoding)
    tell("written")
    return counts
