"""Ownership of code: who wrote an area's lines, who knows it, who is left to ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.numbers import risk
from loomfield.operators.linkage import parts_for

SHARE, STALE_DAYS, INACTIVE_DAYS = 0.1, 365, 90


def by_author(blame: DataFrame, area: str = "area") -> DataFrame:
    """(area, author, lines, files, last, share) from (area, file, author, lines, at); share is of the area's lines."""
    own = blame.groupBy(area, "author").agg(F.sum("lines").alias("lines"), F.count_distinct("file").alias("files"), F.max("at").alias("last"))
    return own.withColumn("share", F.col("lines") / F.sum("lines").over(Window.partitionBy(area)))


def from_maps(chunks: DataFrame, key: str, authors: str) -> DataFrame:
    """(key, author, lines): author maps of chunks added up."""
    return chunks.select(key, F.explode(authors).alias("author", "lines")).groupBy(key, "author").agg(F.sum("lines").alias("lines"))


def last_seen(blame: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """(author, last): the later of an author's newest line and newest commit (author, at)."""
    rows = blame.select("author", "at")
    if commits is not None:
        rows = rows.unionByName(commits.select("author", "at"))
    return rows.groupBy("author").agg(F.max("at").alias("last"))


def departed(seen: DataFrame, now: Column, days: int = INACTIVE_DAYS) -> DataFrame:
    """(author, gone): last seen more than `days` before `now`."""
    return seen.select("author", (F.col("last") < now - F.make_dt_interval(F.lit(days))).alias("gone"))


def health(blame: DataFrame, gone: DataFrame, now: Column, area: str = "area", stale_days: int = STALE_DAYS) -> DataFrame:
    """(area, lines, departed_share, bus_factor, age_days, ask, risk, rank) of each area.

    bus_factor counts active authors with a tenth of the lines; ask is the active author with most of
    them; rank weighs risk by the logarithm of size.
    """
    own = by_author(blame, area).join(gone, "author")
    active = ~F.col("gone")
    out = own.groupBy(area).agg(
        F.sum("lines").alias("lines"),
        (F.sum(F.when(F.col("gone"), F.col("lines")).otherwise(0)) / F.sum("lines")).alias("departed_share"),
        F.sum((active & (F.col("share") >= SHARE)).cast("long")).alias("bus_factor"),
        F.date_diff(now, F.max("last")).alias("age_days"),
        F.max_by("author", F.when(active, F.struct(F.col("lines"), -F.col("author")))).alias("ask"),
    )
    out = out.withColumn("risk", risk(F.col("departed_share"), F.col("age_days"), F.col("bus_factor"), stale_days))
    return out.withColumn("rank", F.col("risk") * F.log10(F.greatest(F.lit(10), F.col("lines"))))


def experts(hits: DataFrame, blame: DataFrame, top: int = 8, files: int = 4) -> DataFrame:
    """(author, weight, share, files, last): similarity times lines over the files found; ties by author."""
    rows = hits.select("file", F.greatest("sim", F.lit(0.0)).alias("sim")).join(blame, "file")
    per = rows.groupBy("author", "file").agg(F.sum(F.col("sim") * F.col("lines")).alias("w"), F.max("at").alias("last"))
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col("w"), (-F.col("file")).alias("f"))), False), 1, files)
    out = per.groupBy("author").agg(F.sum("w").alias("weight"), F.transform(best, lambda x: -x["f"]).alias("files"), F.max("last").alias("last"))
    out = out.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1))))
    return out.orderBy(F.desc("weight"), "author").limit(top)


def shared_files(blame: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """(a, b, files, lines): author pairs of files that `least` to `most` authors wrote; lines is the smaller part's sum."""
    own = blame.groupBy("file", "author").agg(F.sum("lines").alias("lines"))
    sized = own.withColumn("n", F.count("*").over(Window.partitionBy("file"))).where(F.col("n").between(least, most))
    # As many tasks as the pairs need; the pairs of two authors meet before any are added up.
    parts = parts_for(sized.select(((F.col("n") - 1) / 2).alias("n")))
    sized = sized.drop("n")
    other = sized.select("file", F.col("author").alias("b"), F.col("lines").alias("lb"))
    pairs = sized.withColumnsRenamed({"author": "a", "lines": "la"}).join(other, "file").where("a < b")
    return pairs.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("files"), F.sum(F.least("la", "lb")).alias("lines"))


def overlaps(vectors: DataFrame, key: str, vec: Column, top: int = 15) -> DataFrame:
    """(a, b, sim): the most alike of all pairs of a bounded set of areas, neither within the other."""
    a, b = vectors.select(F.col(key).alias("a"), vec.alias("va")), vectors.select(F.col(key).alias("b"), vec.alias("vb"))
    from loomfield.functions.numbers import dot

    pairs = a.join(F.broadcast(b), (F.col("a") < F.col("b")) & ~F.col("b").startswith(F.concat("a", F.lit("/"))))
    return pairs.select("a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("sim")).orderBy(F.desc("sim"), "a", "b").limit(top)


#: Depth and breadth from which on a person counts as deep or broad.
DEEP = BROAD = 1.2


def roles(work: DataFrame, now: Column) -> DataFrame:
    """(person, level, depth, breadth, confidence) from what a person has done, each sign adding to depth or breadth.

    `work` has person, owned_areas, blame (best share of an area's lines), owns (is a code owner), top_commits (in the best area),
    first (first commit), repos and areas (with three commits or more), approved (people), approver_for, maintains, prs, reviews.
    A lead is deep and broad, a domain expert deep, anyone else a contributor; no level where nothing was seen. Nulls count as 0.
    """
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    def scale(value: Column, *steps: tuple[float, float]) -> Column:
        """The points of the highest step that is reached; steps from the highest."""
        out = F.lit(0.0)
        for least, points in reversed(steps):
            out = F.when(value >= least, points).otherwise(out)
        return out

    years = F.coalesce(F.date_diff(now, "first") / 365.25, F.lit(0.0))
    deep = [
        scale(n("owned_areas"), (3, 1.0), (1, 0.6)), scale(n("blame"), (0.25, 0.8), (0.1, 0.4)), scale(n("owns"), (1, 0.6)), scale(n("top_commits"), (30, 0.4)), scale(years, (4, 0.5), (2, 0.3)),
    ]
    spread = [scale(n("repos"), (5, 0.8), (3, 0.5)), scale(n("areas"), (20, 0.6), (10, 0.3))]
    others = [scale(n("approved"), (5, 0.6), (3, 0.3)), scale(n("approver_for"), (3, 0.4)), scale(n("maintains"), (1, 0.4))]
    depth, breadth = sum(deep), sum(spread) + sum(others)
    said = sum((c > 0).cast("int") for c in [*deep, spread[0] + spread[1], *others])
    acts = n("prs") + n("reviews")
    sure = F.least(F.lit(0.7), 0.3 + 0.04 * said + F.least(F.lit(0.08), 0.02 * F.log2(1 + acts / 10)))
    seen = (n("areas") + n("top_commits") + acts > 0) | F.col("first").isNotNull()
    is_deep, is_broad = F.round(depth, 6) >= DEEP, F.round(breadth, 6) >= BROAD
    level = F.when(is_deep & is_broad, "lead").when(is_deep, "domain expert").otherwise("contributor")
    return work.select(
        "person", F.when(seen, level).alias("level"), F.when(seen, F.round(depth, 1)).otherwise(0.0).alias("depth"), F.when(seen, F.round(breadth, 1)).otherwise(0.0).alias("breadth"),
        F.when(seen, F.round(sure, 2)).otherwise(0.0).alias("confidence"),
    )
