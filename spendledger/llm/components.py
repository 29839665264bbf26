"""Connected components of a link table, by repeated contraction."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendledger.llm.common import materialise


def _links(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def components(links: DataFrame) -> DataFrame:
    """``vertex, component`` for the vertices of ``links`` (``a, b``): the smallest vertex reachable.

    In each round every vertex moves to the neighbour (or itself) whose number, hashed
    anew for the round, is least, and from there once more; only the links that still
    join different vertices are kept.  Because the order is another one each round, the
    vertices left shrink by a constant share whatever the ids are: a path of 10,000
    vertices in the order of its ids ends after about ten rounds.  Links and labels stay
    distributed, a vertex with very many links costs one row for each task, and every round ends in
    written tables.  The smallest vertex of each component is found at the end.
    """
    edges = materialise(links.where("a <> b").select(*_links(F.col("a"), F.col("b"))).distinct(), "links")
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        order = lambda v, turn=turn: F.struct(F.xxhash64(F.lit(turn), v).alias("h"), v.alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(both.groupBy("a").agg(F.min(order(F.col("b"))).alias("x")).select(
            F.col("a").alias("vertex"), F.least("x", order(F.col("a")))["v"].alias("parent")), "parents")
        above = parent.select(F.col("vertex").alias("parent"), F.col("parent").alias("grand"))
        step = materialise(parent.join(above, "parent").select("vertex", F.col("grand").alias("parent")), "steps")
        if labels is None:
            labels = step.select("vertex", F.col("parent").alias("component"))
        else:
            moved = step.select(F.col("vertex").alias("component"), "parent")
            labels = materialise(labels.join(moved, "component", "left").select(
                "vertex", F.coalesce("parent", "component").alias("component")), "labels")
        to = step.select(F.col("vertex").alias("a"), F.col("parent").alias("pa"))
        fro = step.select(F.col("vertex").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(to, "a").join(fro, "b").where("pa <> pb")
        edges = materialise(moved.select(*_links(F.col("pa"), F.col("pb"))).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("vertex"), F.col("b").alias("component")).limit(0)
    least = labels.groupBy("component").agg(F.min("vertex").alias("least"))
    return materialise(labels.join(least, "component").select("vertex", F.col("least").alias("component")), "labels")
