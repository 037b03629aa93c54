"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.llm.common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: each node hands its larger neighbours to its smallest neighbour (or itself). Small:
    each node hands its smaller neighbours and itself to the smallest of them.

    Smallest neighbours come from a grouping with partial sums, so a node with very many edges is one row a task
    before the shuffle; joining them back is a sort-merge join whose large partitions Spark can split. It is asked for,
    as Spark would broadcast small tables instead: the driver builds each of these, and steps are many.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two smaller neighbours, or smaller and larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges(a, b); the component is its smallest node. Self-edges and nulls
    are passed over. Alternating large-star and small-star steps, each written out, until the edges are stars."""
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while not _settled(current):
        last, current = current, materialize(_star(_star(current, True), False), name)
        release(last, shuffles=False)
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct())
