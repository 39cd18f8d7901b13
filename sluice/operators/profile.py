"""Column profiles of rows of string fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_boolean, is_datetime, is_null_like, is_numeric


def column_profile(rows: DataFrame, width: int, names: list[str] | None = None, column: str = "fields") -> DataFrame:
    """One row per column: col, name, n_null, min_length, max_length (bytes) and
    whether all values that are not null-like are numbers, booleans or dates."""
    each = rows.select(F.posexplode(column).alias("col", "v")).where(F.col("col") < width)
    some = ~is_null_like(F.col("v"))
    held = lambda test: F.coalesce(F.every(F.when(some, test)), F.lit(True))
    size = F.when(some, F.octet_length("v"))
    out = each.groupBy("col").agg(
        F.count_if(~some).alias("n_null"), F.coalesce(F.min(size), F.lit(0)).alias("min_length"), F.coalesce(F.max(size), F.lit(0)).alias("max_length"),
        held(is_numeric(F.col("v"))).alias("all_numeric"), held(is_boolean(F.col("v"))).alias("all_boolean"), held(is_datetime(F.col("v"))).alias("all_datetime"),
    )
    name = F.concat(F.lit("col_"), F.col("col").cast("string"))
    known = F.coalesce(F.get(F.array(*map(F.lit, names)), F.col("col")), name) if names else name
    return out.withColumn("name", known).select("col", "name", "n_null", "min_length", "max_length", "all_numeric", "all_boolean", "all_datetime")


def field_classes(df: DataFrame, column: str) -> DataFrame:
    """df with is_numeric, is_boolean, is_datetime and is_null of a column."""
    c = F.col(column)
    return df.withColumns({"is_numeric": is_numeric(c), "is_boolean": is_boolean(c), "is_datetime": is_datetime(c), "is_null": is_null_like(c)})
