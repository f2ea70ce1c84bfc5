"""Connected components of a distributed graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (id, component), the smallest id that each node can reach.

    In a round every node points to its smallest neighbour (or itself), pointers are doubled until all
    point to roots, edges are contracted along them, and loops dropped. A component's smallest node is
    a root in every round, so it is what is left of the component. Nodes that still have edges at least
    halve in a round, and doubling takes the logarithm of the longest chain. Nodes without edges (nulls
    and self-loops do not count as edges) don't appear. An empty graph gives no rows.
    """
    scratch = Scratch(edges.sparkSession)
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    live = scratch.put("live", edges.where("a is not null and b is not null and a <> b").select(*pair("a", "b")).distinct())
    labels = live.select(F.col("a").alias("id"), F.col("b").alias("component"))  # no rows unless a round replaces it
    first = True
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.put("step", both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("to")))
        while True:
            onward = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
            doubled = scratch.put("step", step.join(onward, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            step, moved = doubled.select("id", "to"), doubled.where("moved")
            done = moved.isEmpty()
            scratch.drop_older("step")
            if done:
                break
        if first:
            labels, first = step.select("id", F.col("to").alias("component")), False
        else:
            change = step.select(F.col("id").alias("component"), "to")
            labels = labels.join(change, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = scratch.put("labels", labels)
        of_a = step.select(F.col("id").alias("a"), F.col("to").alias("to_a"))
        of_b = step.select(F.col("id").alias("b"), F.col("to").alias("to_b"))
        live = scratch.put("live", live.join(of_a, "a").join(of_b, "b").where("to_a <> to_b").select(*pair("to_a", "to_b")).distinct())
        scratch.drop_older("labels", "live")
    return labels
