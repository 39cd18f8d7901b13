"""Keyed joins of two tables of ragged rows.

Rows are arrays of strings with a line number; a row too short to hold the key
has none and matches nothing. Matched rows are put together as they are; the
missing side of an unmatched row is padded with empty fields. Which side is
built or broadcast, and the splitting of hot keys, is left to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_fields, csv_line, field

HOWS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "right_anti": "right"}


def key_index(key: int | str, header: list[str] | None) -> int:
    """A column by number or by its name in the header; not found: the first."""
    if isinstance(key, int):
        return key
    return header.index(key) if header and key in header else 0


def rows_of(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Lines that are not empty, as rows: line_no, fields."""
    return lines.where("content <> ''").select("line_no", csv_fields(F.col("content"), delimiter).alias("fields"))


def joined(left: DataFrame, right: DataFrame, left_key: int, right_key: int, how: str = "inner", left_width: int = 0, right_width: int = 0, keyless: bool = True) -> DataFrame:
    """left, right: line_no, fields. Returns left_no, right_no, fields; the order
    is that of left_no, then right_no, rows of the right alone last. keyless:
    whether rows of the right without a key are among those."""
    if how not in HOWS:
        raise ValueError(f"unknown join {how!r}")
    l = left.select(F.col("line_no").alias("left_no"), F.col("fields").alias("lf"), field(F.col("fields"), left_key).alias("lk"))  # noqa: E741
    r = right.select(F.col("line_no").alias("right_no"), F.col("fields").alias("rf"), field(F.col("fields"), right_key).alias("rk"))
    r = r if keyless else r.where("rk is not null")
    both = l.join(r, F.col("lk") == F.col("rk"), HOWS[how])
    if how == "right_anti":
        both = both.where("left_no is null")
    empty = lambda n: F.array_repeat(F.lit(""), n)
    return both.select("left_no", "right_no", F.concat(F.coalesce("lf", empty(left_width)), F.coalesce("rf", empty(right_width))).alias("fields"))


def joined_lines(rows: DataFrame, delimiter: str = ",") -> DataFrame:
    """Joined rows as lines with their places (o1, o2, o3); filters and
    duplicates work on these, above the join."""
    return rows.select(F.coalesce(F.col("left_no"), F.lit((1 << 62))).alias("o1"), F.coalesce(F.col("right_no"), F.lit(0)).cast("long").alias("o2"), F.lit(0).cast("long").alias("o3"), csv_line(F.col("fields"), delimiter).alias("content"))


def combined_header(left: list[str], right: list[str], delimiter: str = ",") -> Column:
    return csv_line(F.array(*map(F.lit, [*left, *right])), delimiter)
