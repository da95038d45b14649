"""Distributed connected components over an edge table.

Alternates the large-star and small-star steps of Kiveris et al., "Connected
Components in MapReduce and Beyond" (2014): every step is a grouped minimum and
a join, no node's neighbours are ever collected, and the number of rounds grows
with the logarithm of the longest path. Both sides of each join are read from
tables, so Spark can split a hub's edges among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stored


def _lowest(edges: DataFrame) -> DataFrame:
    """The least neighbour below each node that has one."""
    return stored(edges.groupBy("src").agg(F.min("dst").alias("low")), "least")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (src, dst, of one orderable type) to a stored table (node, label): label is the least node of the component.

    Nodes without an edge and the least node of each component do not appear;
    self-loops, nulls and repeated edges are ignored. ``rounds`` only guards
    against an endless loop: running out raises, nothing is cut short.
    """
    edges = stored(
        edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(),
        "edges",
    )
    for _ in range(rounds):
        # Large star: an edge hangs on the least neighbour of its lower end. If none moves, all are stars.
        low = _lowest(edges)
        risen = stored(edges.join(low.select(F.col("src").alias("dst"), "low"), "dst", "left").select("src", F.coalesce("low", "dst").alias("dst"), F.col("low").isNotNull().alias("moved")), "edges", edges, low)
        if risen.where("moved").isEmpty():
            labels = stored(risen.select(F.col("src").alias("node"), F.col("dst").alias("label")), "labels", risen)
            return labels
        # Small star: a node and its lower neighbours hang on the least of them.
        low = _lowest(risen)
        hung = risen.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").union(low.select("src", F.col("low").alias("dst")))
        edges = stored(hung.distinct(), "edges", risen, low)
    drop(edges)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
