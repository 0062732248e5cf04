"""Average linkage: groups merge while their average similarity is high enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.operators.linkage import group
from loomfield.operators.rounds import written

#: Similarities are summed in units of a billionth, so that sums don't depend on their order.
UNIT = 1_000_000_000


def average_linkage(pairs: DataFrame, goal: float, forced: DataFrame | None = None) -> DataFrame:
    """(item, cluster) of (a, b, sim); a pair that isn't given has similarity 0. A cluster is named by its least item.

    Pairs of `forced` (a, b) merge first. Then the two clusters of the highest average merge, while it is at least `goal` (over
    0). Two clusters that are nearest to each other stay so whatever merges elsewhere, as an average with a union is never higher
    than the higher of its parts; so each round merges all such pairs, and adds up the sums of their links: the clusters of the
    loop that merges one pair at a time, but for ties, which go by name. A round is joins and sums on clusters; no block of
    items or matrix is gathered. Null items, pairs of an item with itself and repeats of a pair (the highest counts) are harmless.
    """
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.round(F.max("sim") * UNIT).cast("decimal(38,0)").alias("total"))
    items = pairs.select(F.col("a").alias("item")).union(pairs.select("b"))
    if forced is not None:
        items = items.union(forced.select("a")).union(forced.select("b"))
    items = items.where("item IS NOT NULL").distinct()
    of = items.select("item", F.col("item").alias("cluster"))
    if forced is not None:
        first = group(forced.select("a", "b"))
        of = items.join(first.select(F.col("node").alias("item"), "component"), "item", "left").select("item", F.coalesce("component", "item").alias("cluster"))
    of = written(of)
    sizes = written(of.groupBy("cluster").agg(F.count("*").alias("n")))
    moves = of.where("item <> cluster").select(F.col("item").alias("gone"), F.col("cluster").alias("into"))
    while True:
        for side in "ab":
            links = links.join(moves.select(F.col("gone").alias(side), F.col("into").alias(f"{side}_into")), side, "left").withColumn(side, F.coalesce(f"{side}_into", side)).drop(f"{side}_into")
        links = written(links.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total")))
        n = lambda c: sizes.select(F.col("cluster").alias(c), F.col("n").alias(f"n_{c}"))  # noqa: E731, B023
        average = F.col("total").cast("double") / (F.col("n_a") * F.col("n_b") * UNIT)
        near = links.join(n("a"), "a").join(n("b"), "b").select("a", "b", average.alias("avg")).where(F.col("avg") >= goal)
        rank = F.struct((-F.col("avg")).alias("low"), "a", "b")
        first = near.select(F.explode(F.array("a", "b")).alias("cluster"), rank.alias("pair")).groupBy("cluster").agg(F.min("pair").alias("pair"))
        both = first.groupBy("pair").agg(F.count("*").alias("n")).where("n = 2")
        moves = written(both.select(F.col("pair.b").alias("gone"), F.col("pair.a").alias("into")))
        if moves.isEmpty():
            return of
        step = moves.withColumnRenamed("gone", "cluster")
        of = written(of.join(step, "cluster", "left").select("item", F.coalesce("into", "cluster").alias("cluster")))
        sizes = of.groupBy("cluster").agg(F.count("*").alias("n"))
