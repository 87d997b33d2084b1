"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.session import materialize


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Links every neighbour of a node (all larger ones, or all smaller ones and itself) to the least of them."""
    both = edges.union(edges.select("b", "a")) if larger else edges  # b > a holds in `edges`
    node, other = ("a", "b") if larger else ("b", "a")
    least = both.groupBy(F.col(node).alias("node")).agg(F.least(F.min(other), F.col("node")).alias("least"))
    near = both.join(least, F.col(node) == F.col("node"))
    if larger:
        out = near.filter("b > a").select(F.col("least").alias("a"), "b")
    else:
        out = near.select(F.col("least").alias("a"), F.col("a").alias("b")).union(least.select("least", "node"))
    return out.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of `edges` (a, b) and the smallest node that it reaches.

    Self-links, repeated edges and either direction are fine; null ends are dropped. A round costs a few joins on
    tables of at most the edges' size; the number of rounds follows the logarithm of the longest path. A hub's
    neighbours meet a single row of the other side, so that adaptive execution can split them.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    now, before = materialize(now, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        now = materialize(_stars(_stars(now, True), False), "stars")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select("a", "a").distinct()
    )
