"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fichero.llm.common import staged


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Edges are longs; loops and repeats are ignored, an empty table gives an empty table. A node with very many
    edges only meets aggregates with partial sums and joins whose other side has one row per node, which Spark
    splits when skewed. Each round is written to the shared folder.
    """
    current = staged(_oriented(edges), "edges")
    while True:
        loose = current.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        inner = current.select(F.col("b").alias("a")).distinct().join(current.select("a").distinct(), "a", "left_semi")
        if loose.unionByName(inner).isEmpty():
            break
        current = staged(_oriented(_small_star(_oriented(_large_star(current)))), "edges")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
