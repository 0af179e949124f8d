"""Connected components of an edge table by alternating stars, on DataFrames.

Each round replaces edges by edges to smaller neighbours (large star, then small star) until every
node hangs directly on the smallest node of its component.  A round is two grouped minima and two
joins; nothing is gathered by component, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v) edges with u > v."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))
    if large:  # neighbours above u go to the least of u and its neighbours
        joined = both.filter("v > u").join(least, F.col("u") == F.col("m_u"))
        out = joined.select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
    else:      # u and its neighbours below go to the least of them
        joined = both.join(least, F.col("u") == F.col("m_u"))
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u"), F.col("m")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the (u, v) edge table with the smallest node it reaches."""
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    sign = F.xxhash64("u", "v").cast("decimal(38,0)")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(sign)).first())
    before = state(edges)
    while before[0]:
        edges = stored(_star(_star(edges, True), False), "cc")
        after = state(edges)
        if after == before:
            break
        before = after
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(edges.select(F.col("v"), F.col("v")).distinct())
