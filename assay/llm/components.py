"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b): every node's neighbours on one side are tied to the smallest one instead."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.hint("merge").join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none of its own."""
    return edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and edges.select(F.col("b").alias("a")).distinct().hint("merge").join(edges.select("a"), "a", "left_semi").isEmpty()


def stars(links: DataFrame) -> DataFrame:
    """links (a long, b long) as (a, b), every node but a component's smallest tied to that one.

    A step sends a row for each edge and needs no row of one node to meet all others in one task: the
    minimum is combined before the shuffle, and the join back is one that adaptive execution can split.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _done(edges):
        edges = written(_star(_star(edges, True), False), "edges")
    return edges
