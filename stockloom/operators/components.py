"""Connected components of undirected edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.session import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Each round links the larger neighbours of a node, and then the smaller ones, to the smallest node
    among them (large and small stars), so the number of rounds grows with the logarithm of the
    longest chain. Every round is written to the shared folder. The smallest neighbours are written
    before they are joined, which lets Spark split the rows of a node with very many edges. Rounds go
    on until only stars are left, which the next round's smallest neighbours show and then answer; loops
    and repeated edges do no harm, and no edges give no rows.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select("a", "b"))
    while True:
        wide, least = _star(now, larger=True)
        if least.where("low < a and low < high").agg(F.count(F.lit(1))).first()[0] == 0:
            discard(spark, now)
            return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
        tight, least_again = _star(wide, larger=False)
        new = written(tight.distinct())
        discard(spark, now, least, least_again)
        now = new


def _star(edges: DataFrame, larger: bool) -> tuple[DataFrame, DataFrame]:
    """One star step and the table of smallest neighbours that it reads."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if larger else both.where("b <= a")
    ends = near.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    least = written(ends.withColumn("m", F.least("low", "a")))
    picked = both.where("b > a") if larger else near
    linked = picked.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        linked = linked.unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b"), least
