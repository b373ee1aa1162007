"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialise

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long), any direction, repeats and loops allowed. Returns (node, root) for every node with an edge to another: root is the component's smallest node.

    Each round links every node's larger neighbours, then its smaller ones and itself, to its smallest neighbour; stars remain, in which each node
    but the centre has one neighbour, and what the centre tells the others is the result. Each round's edges are written to the shared checkpoint
    folder, and what they were made of is removed; the result is such a table as well, for :func:`discard`. Nodes that are null have no
    edges; a graph that has not settled after MOST_ROUNDS rounds raises: rounds grow with the logarithm of the longest path.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        # every edge is (b, a) with b > a; a star's centre may hold a third of all edges, so what it learns is broadcast to them
        both = now.select(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(0).alias("n")).unionByName(now.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1).alias("n")))
        met = both.groupBy("u").agg(F.min("v").alias("m"), F.sum("n").alias("n"), F.count("*").alias("degree"))
        low = materialise(met.select("u", F.least("u", "m").alias("m"), "n", F.expr("m < u AND degree > 1").alias("between")), "low")
        total, between = low.agg(F.sum("n"), F.max("between")).first()
        if not between:
            discard(now)
            found = low.select(F.col("u").alias("node"), F.col("m").alias("root"))
            found.written_to = low.written_to
            return found
        # as many rows as edges, repeated ones among them until the round's end
        large = materialise(join_hot(now.select(F.col("a").alias("u"), F.col("b").alias("v")), low.where("n > 0").select("u", "m", "n"), "u", "n", total=total).select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_hot(large, least, "u", "n", total=total).select(F.explode(F.array(F.struct(F.col("u").alias("b"), F.col("m").alias("a")), F.struct(F.col("v").alias("b"), F.col("m").alias("a")))).alias("e")).select("e.b", "e.a").where("b <> a").distinct()
        small = materialise(small, "small")
        discard(now, low, large, least)
        now = small
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
