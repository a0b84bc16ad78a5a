"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.shared import keep


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over distinct edges (u, v) with u > v; the same form again.

    A node's least neighbour is found by an aggregate that combines before the shuffle, and joined back to the edges, so that the
    centre of a large star is no task of its own.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # large: every larger neighbour to the least one
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    # small: all smaller neighbours and the node itself to the least one
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(least, "u")
    small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return small.where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, component): the least id reachable, for each node that isn't the least itself.

    Links with nulls and of a node with itself say nothing; repeated links count once. No links give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    edges = keep(edges, "edges")
    before = _state(edges)
    while before[0]:
        edges = keep(_star(edges), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
