"""Time-window insights: token series, scores, streaks, momentum, call summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_back(at: Column, now: Column, days: int = 7) -> Column:
    """0 for the last `days` days before `now`, 1 for those before them, and so on; null in the future."""
    age = F.unix_micros(now) - F.unix_micros(at.cast("timestamp"))
    return F.when(age >= 0, F.floor(age / (days * 86_400_000_000)))


def daily(rows: DataFrame, at: str, value: str, first: Column, last: Column) -> DataFrame:
    """(day, value): sums by day with zeros for the days that have no row."""
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    sums = rows.groupBy(F.to_date(at).alias("day")).agg(F.sum(value).alias(value))
    return days.join(sums, "day", "left").select("day", F.coalesce(value, F.lit(0)).alias(value))


def percentiles(rows: DataFrame, by: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """p<n> by group: the value at place min(n - 1, int(n x p)) of the sorted ones, a null counting as 0. Not interpolated.

    Ranks come from a window, so a group's values are sorted with spill and never gathered into one array.
    """
    filled = rows.select(*by, F.coalesce(value, F.lit(0.0)).alias("v"))
    w = Window.partitionBy(*by)
    ranked = filled.withColumns({"i": F.row_number().over(w.orderBy("v")) - 1, "n": F.count("*").over(w)})
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("i") == at(p), F.col("v"))).alias(f"p{round(p * 100)}") for p in points])


def streaks(days: DataFrame, key: list[str], day: str, first: Column, today: Column) -> DataFrame:
    """(key, current, best): runs of days with an item. Weekends never break a run, nor does today before it ends."""
    calendar = days.select(*key).distinct().select(*key, F.explode(F.sequence(first, today)).alias("d"))
    done = days.select(*key, F.col(day).alias("d"), F.lit(1).alias("hit")).distinct()
    rows = calendar.join(done, [*key, "d"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    gap = (F.col("hit") == 0) & (F.weekday("d") < 5) & (F.col("d") != today)
    island = F.sum(gap.cast("int")).over(Window.partitionBy(*key).orderBy("d"))
    runs = rows.withColumn("island", island).groupBy(*key, "island").agg(F.sum("hit").alias("n"))
    return runs.groupBy(*key).agg(F.max_by("n", "island").alias("current"), F.max("n").alias("best"))


def rank_share(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """`place`, the number strictly better plus one, and `percentile`, 100 x (beaten + half of the ties) / others."""
    same = rows.groupBy(*by, value).agg(F.count("*").alias("_same"))  # windows run over the distinct values alone
    w = Window.partitionBy(*by)
    better = F.coalesce(F.sum("_same").over(w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = same.withColumns({"place": better + 1, "_all_n": F.sum("_same").over(w)})
    beaten = F.col("_all_n") - F.col("place") - F.col("_same") + 1
    out = rows.join(placed, [*by, value])
    return out.withColumn("percentile", 100 * (beaten + 0.5 * F.col("_same")) / F.col("_all_n")).drop("_same", "_all_n")


def momentum(series: list[Column], quiet: Column, left: Column) -> Column:
    """A status from weekly counts, oldest first, the days since the last activity and the steps left.

    momentum: two this week at least, and no fewer than the mean of the three weeks before; stalled: quiet for a week with
    something left; cooling: active in this week or the last; else quiet.
    """
    now, before = series[-1], series[-4:-1]
    rising = (now >= 2) & (3 * now >= sum(before, F.lit(0)))
    return F.when(rising, "momentum").when((quiet >= 7) & (left > 0), "stalled").when((now > 0) | (series[-2] > 0), "cooling").otherwise("quiet")
