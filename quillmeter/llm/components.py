"""Connected components of a table of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, save


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component``: every node of ``links`` (two long columns) with the smallest node it reaches.

    A hub's links are never gathered: each step is a minimum per node and a join in which hot nodes are broadcast.
    """
    a, b = links.columns[:2]
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = save(links, "links")
    state = _state(edges)
    for _ in range(most_rounds if state[0] else 0):
        # Large star: every larger neighbour of a node points to the smallest node around it.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        wide = save(lookup(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = wide.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = lookup(wide, least, "u", "n")
        edges = save(near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    pointed = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    return pointed.union(roots.select("node", F.col("node").alias("component")))
