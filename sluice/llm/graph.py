"""Connected components of an edge table, by alternating large and small stars.

Each round links every node to the least neighbour it knows of; a round is kept
as a table in the shared folder, and the rounds end once one changes nothing.
The joins are salted by the other end of the edge, so that the edges of a much
linked node spread over tasks. No edge or component is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

SALTS = 16


def _salted(edges: DataFrame, least: DataFrame) -> DataFrame:
    left = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    right = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # No broadcast: sizes are estimated before the salts multiply the rows.
    return left.join(right.hint("merge"), ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long, not null). Returns node, root for every node but the
    roots; a root is the least node of its component. No edges: no rows."""
    now = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _salted(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == (mark := (row[0], row[1])):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
