"""Connected components of an edge table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connect(labels: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """labels(node, comp) with the components that edges(a, b) between nodes join given one label, the least.

    Labels are contracted: each round, every label takes the least label next to it, and labels are then followed
    once more (pointer jumping). Only labels that an edge touches take part.
    """
    of = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    e = edges.join(of.withColumnsRenamed({"_n": "a", "_c": "x"}), "a").join(of.withColumnsRenamed({"_n": "b", "_c": "y"}), "b")
    e = common.materialize(e.where("x != y").select("x", "y").union(e.where("x != y").select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    moved = None
    for _ in range(rounds):
        if e.isEmpty():
            break
        # Every label goes to the least of itself and its neighbours, then to where that one goes.
        hop = e.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        hop = hop.alias("h").join(hop.alias("g"), F.col("h.m") == F.col("g.x"), "left").select(F.col("h.x").alias("x"), F.coalesce(F.least("h.m", "g.m"), F.col("h.m")).alias("m"))
        hop = common.materialize(hop, "hop")
        if moved is None:
            moved = hop
        else:
            on = moved.alias("o").join(hop.alias("h"), F.col("o.m") == F.col("h.x"), "left").select(F.col("o.x").alias("x"), F.coalesce(F.col("h.m"), F.col("o.m")).alias("m"))
            moved = common.materialize(on, "moved")
        e = e.join(hop.withColumnsRenamed({"m": "x2"}), "x").join(hop.withColumnsRenamed({"x": "y", "m": "y2"}), "y")
        e = common.materialize(e.where("x2 != y2").select(F.col("x2").alias("x"), F.col("y2").alias("y")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if moved is None:
        return labels
    out = labels.alias("l").join(moved.alias("o"), F.col("l.comp") == F.col("o.x"), "left").select("l.node", F.coalesce(F.col("o.m"), F.col("l.comp")).alias("comp"))
    return common.materialize(out, "labels")
