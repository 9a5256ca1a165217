"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a partial minimum per node and a join of the node's edges with it. Nodes with more than a HUBS-th of all
edges, so HUBS at most, are joined by broadcast, so their edges stay where they are; any other node has so few that
its task is no larger than the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm.common import materialise, remove_table

#: Nodes that are broadcast, at most.
HUBS = 1000


def _print(edges: DataFrame):
    """A scalar that tells two edge tables apart; its first part is the number of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """edges (a, b) with the m of least (a, m, n: how many edges a has)."""
    least = materialise(least, "least")
    hub = F.col("n") > max(1, rows // HUBS)
    hubs = F.broadcast(least.where(hub).select("a", "m"))
    rest = edges.join(hubs.select("a"), "a", "left_anti").join(least.where(~hub).select("a", "m"), "a")
    return edges.join(hubs, "a").unionByName(rest), least


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b)."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _print(now)
    while True:
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour (or itself)
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rows, spent = _with_least(both, both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), 2 * seen[0])
        large = materialise(rows.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        remove_table(spent)
        # small star: a node and its smaller neighbours are tied to the smallest of them
        rows, spent = _with_least(large, large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), seen[0])
        small = rows.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(spent.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old, now = now, materialise(small, "edges")
        for t in (old, large, spent):
            remove_table(t)
        mark = _print(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("node")).distinct()
    out = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), "components")
    remove_table(now)
    return out
