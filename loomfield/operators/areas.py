"""Areas of a code base that follow its size: large folders are split into the folders below, small ones stay whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE, LEAST, LEVELS = 0.06, 120, 4


def folder(path: Column) -> Column:
    """The folder of a path, `.` for one at the top."""
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def _prefixes(folder_: Column, levels: int) -> Column:
    """The first folders of a folder, from the top, `levels` at most."""
    parts = F.split(folder_, "/")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(levels))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def adaptive_areas(files: DataFrame, repo: str = "repo", path: str = "path", share: float = SHARE, least: int = LEAST, levels: int = LEVELS) -> DataFrame:
    """`files` with `area`: the deepest kept folder above each file.

    Folders at the top are kept; one below is kept if the folder above it holds more than max(`least`, `share` of the repo's rows)
    and it is among the first `levels`. A folder holds at least as much as any below it, so this is what splitting from the top
    gives, in one pass over counts of folders: rows are counted once by folder, and folders, not rows, are expanded.
    """
    own = files.withColumn("_folder", folder(F.col(path)))
    held = own.groupBy(F.col(repo).alias("repo"), F.col("_folder").alias("folder")).agg(F.count("*").alias("n"))
    limit = held.groupBy("repo").agg(F.greatest(F.lit(float(least)), F.sum("n") * share).alias("most"))
    spread = held.where("folder <> '.'").select("repo", "folder", "n", F.posexplode(_prefixes(F.col("folder"), levels)).alias("depth", "prefix"))
    counts = spread.groupBy("repo", "prefix", "depth").agg(F.sum("n").alias("held"))
    above = counts.join(limit, "repo").where("held > most").select("repo", F.col("prefix").alias("parent"), F.lit(True).alias("split"))
    kept = counts.withColumn("parent", F.regexp_replace("prefix", "/[^/]*$", "")).join(above, ["repo", "parent"], "left").where("depth = 0 OR split")
    area = spread.join(kept.select("repo", "prefix"), ["repo", "prefix"]).groupBy("repo", "folder").agg(F.max_by("prefix", "depth").alias("area"))
    area = area.withColumnsRenamed({"repo": "_repo", "folder": "_of"})
    joined = own.join(area, F.col(repo).eqNullSafe(F.col("_repo")) & (F.col("_folder") == F.col("_of")), "left")
    return joined.select(*files.columns, F.coalesce("area", F.lit(".")).alias("area"))


def area_vectors(files: DataFrame, repo: str = "repo", vector: str = "vec", author: str = "author", at: str = "at") -> DataFrame:
    """(repo, area, n, centroid, owners, last) of files with `area`: the mean direction, rows by author (most first), the latest time."""
    parts = files.select(repo, "area", F.posexplode(vector).alias("i", "x")).groupBy(repo, "area", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = parts.groupBy(repo, "area").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) + 1e-9
    centroid = sums.withColumn("_len", length).select(repo, "area", F.transform("v", lambda x: x / F.col("_len")).alias("centroid"))
    by_author = files.groupBy(repo, "area", author).agg(F.count("*").alias("k"), F.max(at).alias("t"))
    people = by_author.groupBy(repo, "area").agg(
        F.sum("k").alias("n"), F.max("t").alias("last"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("less"), F.col(author).alias("who")))), lambda p: F.struct(p["who"].alias("author"), (-p["less"]).alias("n"))).alias("owners"),
    )
    return people.join(centroid, [repo, "area"], "left").select(repo, "area", "n", "centroid", "owners", "last")
