"""Connected components of a graph given as edges between longs, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("long"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge; the root is its component's least node.

    Alternating large-star and small-star rounds, which halve the distances to the root, each
    kept in the shared folder. Edges with a null end and loops count for nothing.
    """
    now = keep(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v").distinct())
    state = _state(now)
    while state[0]:
        now = keep(_small_star(_large_star(now).distinct()).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
