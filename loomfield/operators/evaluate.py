"""Evaluation of ranked lists and pair sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hit_rates(relevant: DataFrame, query: str, rank: str, at: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """n, hit<k> for each k and mrr over the queries that have a relevant row, by its best rank."""
    best = relevant.groupBy(query).agg(F.min(rank).alias("rank"))
    rates = [F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"hit{k}") for k in at]
    return best.agg(F.count("*").alias("n"), *rates, F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


def expected_hit(counts: DataFrame, query: str, score: str, k: int) -> DataFrame:
    """`p`: the chance that a row is among the first k of its query if ties of score stand in random order."""
    w = Window.partitionBy(query)
    better = F.rank().over(w.orderBy(F.desc(score))) - 1
    rows = counts.withColumn("ties", F.count("*").over(Window.partitionBy(query, score)))
    return rows.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (k - better) / F.col("ties"))))


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts of two systems' hits and the chi-square with continuity correction."""
    only = lambda x, y: F.sum((F.col(x) & ~F.col(y)).cast("long"))
    out = rows.agg(only(a, b).alias("only_a"), only(b, a).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    return out.withColumn("chi2", F.when(n > 0, F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)), 2) / n).otherwise(0.0))


def pair_scores(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of a set of pairs."""
    both = found.select(*keys, F.lit(1).alias("f")).distinct().join(truth.select(*keys, F.lit(1).alias("t")).distinct(), keys, "full_outer")
    sums = both.agg(F.sum(F.coalesce(F.col("f") * F.col("t"), F.lit(0))).alias("hit"), F.sum("f").alias("f"), F.sum("t").alias("t"))
    p, r = F.col("hit") / F.col("f"), F.col("hit") / F.col("t")
    return sums.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))
