"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each edge of different nodes once in either direction."""
    return cut(pairs.union(pairs.select(F.col("v"), F.col("u"))).where("u <> v").distinct())


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): for every node of an edge the smallest node reachable from it.

    Each round joins a node to the first, by a hash, of itself and its neighbours; nodes joined
    to the same one become one node of the next round, which keeps the edges between
    different ones.  Half the nodes of a path are left by that, and far fewer of a dense
    graph, so all rounds together cost about as much as the first two.  Then components
    go back from each round's nodes to those of the round before.  Nodes without edges are
    not here: they are their own component.
    """
    both = _both_ways(edges.select(F.col(left).alias("u"), F.col(right).alias("v")))
    rounds: list[DataFrame] = []
    # By group of a round, the smallest node of the input in it.
    least_of = lambda joined: joined.groupBy("label").agg(F.min("least").alias("least"))
    while not both.isEmpty():
        # Another order now and then, so that no two names with one hash go on for ever.
        order = [F.xxhash64(c, F.lit(len(rounds) // 8)) for c in ("u", "v")]
        nearest = both.groupBy("u").agg(F.min_by("v", order[1]).alias("v"))
        first = (order[1] < order[0]) | ((order[1] == order[0]) & (F.col("v") < F.col("u")))
        joined = nearest.select("u", F.when(first, F.col("v")).otherwise(F.col("u")).alias("label"))
        joined = cut(joined.join(least_of(rounds[-1]).withColumnRenamed("label", "u"), "u") if rounds else joined.withColumn("least", F.col("u")))
        rounds.append(joined)
        of_u, of_v = joined.select("u", F.col("label").alias("to_u")), joined.select(F.col("u").alias("v"), F.col("label").alias("to_v"))
        both = _both_ways(both.where("u < v").join(of_u, "u").join(of_v, "v").select(F.col("to_u").alias("u"), F.col("to_v").alias("v")))
    if not rounds:
        return both.select(F.col("u").alias("node"), F.col("v").alias("component"))
    placed = None
    for joined in reversed(rounds):
        known = least_of(joined).withColumnRenamed("least", "component")
        if placed is not None:
            known = least_of(joined).join(placed.select(F.col("node").alias("label"), "component"), "label", "left").select("label", F.coalesce("component", "least").alias("component"))
        placed = joined.join(known, "label").select(F.col("u").alias("node"), "component")
    return cut(placed)
