"""Connected components by contraction: each round at least halves the nodes that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): the smallest node of its component.

    In a round every node takes the smallest of itself and its neighbours and
    edges move to these; a component's smallest node never moves. Each round's
    tables are written, so lost executors cost one round at most.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct())
    moves = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        moves.append(move)
        to = lambda name: move.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))  # noqa: E731, B023
        moved = left.join(to("a"), "a").join(to("b"), "b")
        left = written(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).where("a <> b").distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))
    out = moves[0]
    for move in moves[1:]:
        further = move.select(F.col("node").alias("root"), F.col("root").alias("__next"))
        out = out.join(further, "root", "left").select("node", F.coalesce("__next", "root").alias("root"))
    return out
