"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prepkit.llm.common import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over links (u, v) with u > v.  Large star: each node links its
    larger neighbours to the least of its neighbours and itself.  Small star: each
    node links its smaller neighbours and itself to the least of them.  A hub's
    neighbours are never gathered in a row: the least is a partial aggregate, and
    the join with it can be split where a hub is hot."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v") if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["at"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("at", "m"))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (the least node reachable) of every node that a link
    joins to another.  Nodes have any type that sorts, without NULLs; links may be
    repeated, in either direction, or join a node to itself.  Steps alternate until
    the links stand still, a logarithmic number; each is written to the shared folder."""
    links = stage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")

    still = links.limit(1).count() == 0
    while not still:
        before, links = links, stage(_stars(_stars(links, large=True), large=False), "links")
        # both are sets: alike if equally many and none of these is new
        still = links.count() == before.count() and links.join(before, ["u", "v"], "left_anti").limit(1).count() == 0
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
