"""Connected components by rounds of contraction, as DataFrame joins.

Each round every node points to its smallest neighbour (or itself), pointers are
followed once more, edges are rewritten to the pointed-to nodes, and inner edges
drop out. Every node that isn't a root merges, so the rounds grow with the
logarithm of the longest path. Each round is written to the shared folder; only
whether edges are left comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (src long, dst long); root is the smallest node.

    Null ends and loops are ignored.
    """
    edges = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = both.groupBy("src").agg(F.min("dst").alias("least")).select(F.col("src").alias("node"), F.least("src", "least").alias("up"))
        near = materialize(near, "pointers")
        second = near.where("node <> up").select(F.col("node").alias("via"), F.col("up").alias("far"))
        up = near.join(second, near["up"] == second["via"], "left").select("node", F.coalesce("far", "up").alias("up"))
        up = materialize(up, "pointers")
        rounds.append(up)
        a = up.select(F.col("node").alias("src"), F.col("up").alias("a"))
        b = up.select(F.col("node").alias("dst"), F.col("up").alias("b"))
        moved = edges.join(a, "src").join(b, "dst").where("a <> b")
        edges = materialize(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    found = rounds[-1].select("node", F.col("up").alias("root"))
    for up in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("up"), F.col("root"))
        found = up.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
        found = materialize(found, "components")
    return found
