"""Connected components of an edge table, by rounds of large-star and small-star written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove


def _stars(both: DataFrame, large: bool) -> DataFrame:
    """One half-round on (u, v) pairs: neighbours of u (all larger ones, or all smaller ones and u) move to u's least neighbour."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    down = joined.where("v < u")
    return down.select(F.col("v").alias("a"), F.col("m").alias("b")).union(down.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether the distinct pairs (a, b), b < a, are stars: every a has one b, and none is a b itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    found = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("root"))
    return found.where("ups > 1 or ups = 1 and root = 0").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) of every node of (u, v), comp its component's smallest node. An empty table gives an empty one."""
    edges = cut(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "cc", paths := [])
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _stars(both, True).where("a <> b")
        large = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        edges = cut(_stars(large, False).where("a <> b").distinct(), "cc", paths)
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    remove(edges.sparkSession, paths[:-1])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
