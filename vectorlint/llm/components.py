"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlint.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: bigint); label is the
    smallest node reachable.

    Large star: every node ties its larger neighbours to its smallest one;
    small star: it ties its smaller neighbours together there.  Repeated until
    only stars are left (the number of rounds grows with the logarithm of the
    longest path), whatever their number; each round's edges are written to
    the shared checkpoint folder.  Minima are pre-aggregated, joins on a hot
    centre are left to AQE's skew splitting.  Every node has its minimum; the outer
    joins keep Spark from broadcasting the edges, whose files are small for their
    number: only the minima may be, by their size in memory.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _only_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u", "left").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u", "left").where("NOT (v <=> m)").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _only_stars(e: DataFrame) -> bool:
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("tied"), F.lit(0).alias("centre")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("tied"), F.lit(1).alias("centre")))
    return ends.groupBy("x").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre")).where("tied > 1 OR (tied = 1 AND centre = 1)").isEmpty()
