"""Connected components of a graph that is too large for one machine, by contraction towards smaller ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatecast.llm.common import checkpoint


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is called by its least node.

    Each round points every node to the least of itself and its neighbours, follows those pointers to their ends by
    doubling, redraws the edges between the ends and drops loops and repeats. As every node with an edge shares its end
    with another, each round at least halves the nodes that are left, long chains included. Only sums (``min``) are
    taken by node, so a node with a third of all edges is combined before the shuffle; the joins have one row a node on
    one side, and what they read is written before, so that Spark can split a crowded key. Edges with a null end are dropped.
    """
    edges = checkpoint(edges.select("a", "b").where("a != b").distinct())
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")))
        while True:  # pointers lead to smaller nodes only, so they end
            ahead = least.select(F.col("node").alias("to"), F.col("to").alias("end"))
            jumped = checkpoint(least.join(ahead, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
            if jumped.where("moved").isEmpty():
                break
            least = jumped.drop("moved")
        maps.append(least)
        one = edges.join(least.withColumnsRenamed({"node": "a", "to": "x"}), "a").select("x", "b")
        two = one.join(least.withColumnsRenamed({"node": "b", "to": "y"}), "b").select("x", "y")
        edges = checkpoint(two.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = None
    for step in reversed(maps):  # from the last map back: where a node's image ends up
        if out is None:
            out = step.withColumnRenamed("to", "component")
        else:
            end = out.withColumnsRenamed({"node": "to", "component": "end"})
            out = step.join(end, "to", "left").select("node", F.coalesce("end", "to").alias("component"))
    return checkpoint(out)
