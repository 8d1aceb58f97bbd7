"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit import runtime
from profilekit.runtime import cut_lineage

# Classes that are sent to workers have methods that name these modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(runtime)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (one of its nodes) for every node with an edge to another one.

    Each round every node points at the neighbour that is first in an order of
    all nodes, or at itself, pointers are followed twice more, and the edges are
    rewritten between the nodes pointed at. The first order is that of the nodes
    themselves, which settles most links that come as stars around their least
    nodes; from then on it is another one by hash each round, so falling paths
    are short even in a chain, and most nodes that are not the first around them
    disappear. No links are lost. Groupings are by partial minimum, joins on a
    frequent node can be split by AQE, and each round is cut off through the
    shared checkpoint folder. Joins are by shuffle at every size: relations
    broadcast in every round would gather in the driver. Null ends and loops are
    ignored; no edges give an empty result.
    """
    edges = cut_lineage(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    )
    found: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda node: F.struct((F.xxhash64(node, F.lit(turn)) if turn > 1 else F.lit(0)).alias("rank"), F.col(node).alias("node"))  # noqa: B023, E731
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("p"))
        up = cut_lineage(up.select(F.col("a").alias("node"), F.least(rank("a"), "p")["node"].alias("p")))
        after, far = up.select(F.col("node").alias("p"), F.col("p").alias("q")).hint("merge"), up
        for _ in range(2):
            far = far.join(after, "p").select("node", F.col("q").alias("p"))
        up = cut_lineage(far)
        to = lambda side: up.select(F.col("node").alias(side), F.col("p").alias(f"{side}_to")).hint("merge")  # noqa: B023, E731
        edges = cut_lineage(
            edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a != b").distinct()
        )
        if found is None:
            found = up.select("node", F.col("p").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), "p").hint("merge")
            found = found.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return cut_lineage(found)
