"""People: typed edges, closeness, identity candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.numbers import half_life
from loomfield.operators.rounds import written


def edge_weights(acts: DataFrame, weights: dict[str, float], now: Column, days: float = 120) -> DataFrame:
    """(a, b, weight) of undirected acts (a, b, kind, n, last): sum of weight x log1p(n), halved every `days`; a missing time counts a quarter."""
    kind = F.lit(0.0)
    for name, w in weights.items():
        kind = F.when(F.col("kind") == name, w).otherwise(kind)
    age = (F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 86_400_000_000
    rows = acts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (kind * F.log1p("n") * half_life(age, days, 0.25)).alias("w"))
    return rows.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("weight"))


def closeness(direct: DataFrame, best: DataFrame) -> DataFrame:
    """(person, closeness): direct weight (via, w) plus a quarter of the best path over one other (person, p: the product of its two weights), by the largest."""
    share = lambda x, y: F.when(F.col(y) == 0, F.lit(float("nan"))).otherwise(F.col(x) / F.col(y))
    paths = best.crossJoin(F.broadcast(direct.agg(F.max("w").alias("most")))).select("person", share("p", "most").alias("p"))
    raw = direct.select(F.col("via").alias("person"), "w").join(paths, "person", "full_outer").select("person", (F.coalesce("w", F.lit(0.0)) + 0.25 * F.coalesce("p", F.lit(0.0))).alias("raw"))
    raw = written(raw)  # its largest is asked of it too
    return raw.crossJoin(F.broadcast(raw.agg(F.max("raw").alias("top")))).select("person", F.round(share("raw", "top"), 6).alias("closeness"))


def candidate_scores(pairs: DataFrame) -> DataFrame:
    """`score` of identity candidates (base, same_repo, same_month, same_task, reviewed), at most 0.99."""
    bonus = lambda c, x: F.when(F.coalesce(F.col(c), F.lit(False)), x).otherwise(0.0)
    total = F.col("base") + bonus("same_repo", 0.08) + bonus("same_month", 0.04) + bonus("same_task", 0.08) - bonus("reviewed", 0.4)
    return pairs.withColumn("score", F.round(F.least(F.lit(0.99), total), 6))


def ego(edges: DataFrame, me, top: int = 20) -> DataFrame:
    """(person, weight): who is tied to one person, the strongest first; ties by person."""
    mine = edges.where((F.col("a") == F.lit(me)) | (F.col("b") == F.lit(me)))
    person = F.when(F.col("a") == F.lit(me), F.col("b")).otherwise(F.col("a"))
    return mine.select(person.alias("person"), "weight").orderBy(F.desc("weight"), "person").limit(top)


def peers(counts: DataFrame, person: str, value: str) -> DataFrame:
    """(person, value, place, percentile) among all; the share beaten counts half of the ties."""
    from loomfield.operators.insights import rank_share

    return rank_share(counts.withColumn("_all", F.lit(1)), ["_all"], value).select(person, value, "place", "percentile")


def decayed_pairs(old: DataFrame, new: DataFrame, factor: float, least: float = 0.05) -> DataFrame:
    """(a, b, n): pair counts of before, decayed, plus the new ones; what falls below `least` goes."""
    rows = old.select("a", "b", (F.col("n") * factor).alias("n")).unionByName(new.select("a", "b", F.col("n").cast("double").alias("n")))
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def merge_records(records: DataFrame, keys: list[str], longest: str) -> DataFrame:
    """One record a component of records (id, keys...) that share a strong key: blanks are filled, the longest name wins."""
    from loomfield.operators.linkage import group

    named = records.select(F.concat(F.lit("r:"), F.col("id").cast("string")).alias("a"), F.explode(F.array(*[F.concat(F.lit(f"{k}:"), F.col(k)) for k in keys])).alias("b"))
    of = group(named.where("b IS NOT NULL")).where(F.col("node").startswith("r:")).select(F.substring("node", 3, 100).alias("_id"), "component")
    rows = records.join(of, records.id.cast("string") == F.col("_id"), "left").withColumn("component", F.coalesce("component", F.concat(F.lit("r:"), F.col("id").cast("string"))))
    first = [F.min_by(k, F.when(F.col(k).isNotNull(), F.col("id"))).alias(k) for k in keys]
    return rows.groupBy("component").agg(F.min("id").alias("id"), *first, F.max_by(longest, F.struct(F.length(longest), -F.col("id"))).alias(longest)).drop("component")
