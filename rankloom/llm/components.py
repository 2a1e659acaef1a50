"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.chunks import written_once


def towards_least(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def under_least(edges: DataFrame) -> DataFrame:
    """A node (a > b) and its lesser neighbours are tied to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the label is the least node of its component.

    Edges turn step by step into stars around the least node; a component of n
    nodes takes about log n rounds.  Each round is stored, so nothing is
    computed twice and no lineage grows.  Loops and repeated edges do no harm.
    """
    stars = written_once(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0"
    )
    state = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        stars = written_once(under_least(towards_least(stars)), "edges")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(stars.select("b", "b").distinct())
