"""Connected components by alternating star contraction, all of it in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import drop_table, persist_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node that edges (a, b) touch; a component is called by its least node.

    Each round joins on nodes and keeps at most one row for each edge, written to the shared folder; no list of nodes or
    edges of a component is ever in one task. Loops and repeated edges count once, nulls are left out.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    now = persist_table(now, "edges")
    before = None
    for _ in range(rounds):
        step = persist_table(_small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct(), "star")
        # the sum of hashes tells whether a round changed any edge
        state = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = step
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
