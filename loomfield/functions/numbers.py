"""Vector, decay and value expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the score.
TOKEN_WEIGHTS = {"input": 1.0, "cache_write": 1.25, "cache_read": 0.1, "output": 5.0}
POINTS = {"pr_merged": 10, "thread_closed": 5, "ticket_done": 3, "review": 2, "commit": 1, "item_closed": 1}
COMMIT_CAP = 30
SCORE_FLOOR = 1e6


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, small: float = 1e-9) -> Column:
    norm = F.sqrt(dot(v, v)) + small
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def half_life(age_days: Column, days: float, missing: float) -> Column:
    """0.5 ** (age / days); `missing` where the age is null."""
    return F.coalesce(F.pow(F.lit(0.5), age_days / days), F.lit(missing))


def weighted_tokens(**columns: str) -> Column:
    out = F.lit(0.0)
    for kind, name in columns.items():
        out = out + TOKEN_WEIGHTS[kind] * F.coalesce(F.col(name), F.lit(0))
    return out


def value_points(counts: dict[str, Column]) -> Column:
    out = F.lit(0)
    for kind, n in counts.items():
        n = F.coalesce(n, F.lit(0))
        out = out + POINTS[kind] * (F.least(n, F.lit(COMMIT_CAP)) if kind == "commit" else n)
    return out


def score(points: Column, tokens: Column) -> Column:
    """100 x points per million weighted tokens, at least one million; null without tokens. Halves round to even."""
    return F.when(tokens > 0, F.bround(100 * points / (F.greatest(tokens, F.lit(SCORE_FLOOR)) / 1e6), 0))


def risk(departed: Column, age_days: Column, bus_factor: Column, stale_days: int) -> Column:
    """0 to 1 from an area's departed share, its age past `stale_days`, and nobody active with a tenth of it."""
    age = F.least(F.lit(1.0), F.coalesce(age_days, F.lit(0)) / (2.0 * stale_days))
    return F.round(F.least(F.lit(1.0), 0.6 * departed + 0.25 * age + F.when(bus_factor == 0, 0.15).otherwise(0.0)), 3)
