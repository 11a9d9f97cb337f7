"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def lowest(edges: DataFrame) -> DataFrame:
    """For each node u its smallest neighbour m, itself included. Partial minima leave each task, so no node is hot."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's smallest neighbour."""
    linked = both_ways(edges)
    return linked.filter("v > u").join(lowest(linked), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(lowest(down), "u")
    rows = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return rows.filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of `links`, whose columns `a` and `b` are of one
    ordered type. Self-links and nulls are ignored, repeated links count once; no links give an empty table. Each round
    is a table in the shared folder; the driver sees only counts and one checksum."""
    edges = links.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")).filter("u <> v").distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(most_rounds):
        found = written(small_star(large_star(edges)), "stars")
        now = found.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        removed(edges.sparkSession, edges)
        edges = found
        if tuple(now) == before or not now[0]:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
