"""Duplicate lines, by the whole line or a range of its fields, in a given order.

The first or last line of a key is found with a row number of 1, which Spark
limits inside each task before it shuffles, so a line that makes up most of the
input costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, column_range, csv_fields
from ..spec import DedupSpec


def with_key(lines: DataFrame, spec: DedupSpec, column: str = "content", compat: str = "documented") -> DataFrame:
    """Adds _key, what makes two lines duplicates: the line, or the array of its
    fields in the range (in observed compatibility joined unquoted, so that
    different fields may collide). The fields are a column of their own first,
    so that a line is split once."""
    if spec.key != "columns":
        return lines.withColumn("_key", ascii_lower(F.col(column)) if spec.ignore_case else F.col(column))
    key = column_range(F.col("_fields"), spec.first, spec.last)
    if compat == "observed":
        key = F.array_join(key, spec.delimiter)
        key = ascii_lower(key) if spec.ignore_case else key
    elif spec.ignore_case:
        key = F.transform(key, ascii_lower)
    return lines.withColumn("_fields", csv_fields(F.col(column), spec.delimiter)).withColumn("_key", key).drop("_fields")


def deduplicated(lines: DataFrame, spec: DedupSpec, order: list[str], column: str = "content", compat: str = "documented") -> DataFrame:
    """lines without duplicates. order: columns of the output's order.
    last: the last line of a key, at its own place; last_in_place: its content at
    the place of the first; all: every line stays."""
    keep = "first" if compat == "observed" and spec.keep in ("last", "all") else spec.keep
    if spec.key == "none" or keep == "all":
        return lines
    keyed = with_key(lines, spec, column, compat)
    down = [F.col(c).desc() for c in order]
    rank = lambda by: F.row_number().over(Window.partitionBy("_key").orderBy(*by))
    if keep == "last_in_place":
        first = keyed.withColumn("_n", rank(order)).where("_n = 1").drop("_n", column)
        last = keyed.withColumn("_n", rank(down)).where("_n = 1").select(F.col("_key").alias("_last_key"), column)
        return first.join(last, F.col("_key").eqNullSafe(F.col("_last_key"))).select(lines.columns)
    return keyed.withColumn("_n", rank(down if keep == "last" else order)).where("_n = 1").select(lines.columns)


def duplicate_counts(lines: DataFrame, spec: DedupSpec, column: str = "content") -> DataFrame:
    """One row: n_lines, n_unique, n_duplicates."""
    per_key = with_key(lines, spec, column).groupBy("_key").agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_lines"), F.count("*").alias("n_unique"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def cleaned_counts(lines: DataFrame, stays: Column, spec: DedupSpec, column: str = "content") -> DataFrame:
    """One row of what a filter and then a search for duplicates leave of lines:
    n_in, n_filtered, n_duplicates, n_out. One pass: keys are counted, not kept."""
    marked = with_key(lines.withColumn("_stays", F.coalesce(stays, F.lit(False))), spec, column)
    per_key = marked.groupBy(F.when(F.col("_stays"), F.col("_key")).alias("_key"), "_stays").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    unique = 0 if spec.key == "none" else F.when(F.col("_stays"), F.col("n") - 1).otherwise(0)
    out = per_key.agg(total("n").alias("n_in"), total(F.when(~F.col("_stays"), F.col("n"))).alias("n_filtered"), total(F.lit(unique) if spec.key == "none" else unique).alias("n_duplicates"))
    return out.withColumn("n_out", F.col("n_in") - F.col("n_filtered") - F.col("n_duplicates"))
