"""Connected components of an edge table, without hubs in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); nodes are longs and a root names its component.

    Each round sends every node to the neighbour (or itself) of the least hash, in an order new
    in each round, and contracts the edges; nodes left shrink by a constant factor. All per-node
    work is a sum-like aggregate or a join that AQE can split, and each round ends in a written
    table, so nothing is gathered and lost executors repeat one round only. No edges: no rows.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while not e.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))
        both = e.union(e.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("from"), F.least("m", rank("a"))["v"].alias("to"))
        nearest = written(nearest, "nearest")
        if labels is None:
            made = nearest.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            made = labels.join(nearest, labels["root"] == nearest["from"], "left").select("node", F.coalesce("to", "root").alias("root"))
        old, labels = labels, written(made, "labels")
        left = (
            e.join(nearest.toDF("a", "ra"), "a").join(nearest.toDF("b", "rb"), "b")
            .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        left = written(left, "edges")
        discard(e, nearest, *([old] if old is not None else []))
        e = left
    return labels if labels is not None else e.toDF("node", "root")
