"""Connected components over a table of edges, by alternating large-star and small-star steps.

Each step is a minimum per vertex and a join back on the vertex, so no neighbour list is ever gathered
in one place and a vertex with very many edges is a skewed join that adaptive execution can split. The
number of rounds grows with the logarithm of the component's size. Each round's edges are written to
the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import discard, materialize

ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; `component` is its least node.

    Loops, repeated edges and null ends count for nothing. Nodes without an edge are not returned.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(ROUNDS):
        # Two numbers a round come to the driver; equal ones twice mean that no edge has moved.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before, last = mark, now
        now = materialize(_star(_star(last, True), False))
        discard(last)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
