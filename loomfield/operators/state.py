"""Incremental state: upserts, change capture, hash differences and last-wins merges, as joins of old and new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), greatest: tuple[str, ...] = ()) -> DataFrame:
    """All rows after the upsert: new values win, `keep` columns keep the old one, `greatest` the larger."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = o.join(n, on, "full_outer")
    is_new = F.col(f"n.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            return F.coalesce(b, a)
        if c in greatest:
            return F.greatest(a, b)
        if c in keep:
            return F.coalesce(a, b)
        return F.when(is_new, b).otherwise(a)

    return joined.select(*[value(c).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and the new ones whose key is not among them."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def changed(old: DataFrame, new: DataFrame, key: str, hash_col: str = "hash") -> DataFrame:
    """(key, action): add, update or gone; rows whose hash is the same are not returned."""
    o, n = old.select(key, F.col(hash_col).alias("_old")), new.select(key, F.col(hash_col).alias("_new"))
    joined = o.join(n, key, "full_outer")
    action = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "gone").when(F.col("_old") != F.col("_new"), "update")
    return joined.select(key, action.alias("action")).where("action IS NOT NULL")


def change_rows(old: DataFrame, new: DataFrame, key: str, fields: list[str], longest: int = 300) -> DataFrame:
    """(key, field, old, new) of every field that differs, null-safe; values of `longest` characters or more are left out."""
    pack = lambda side: F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f"{side}.{f}").cast("string") for f in fields]))
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    pairs = joined.select(F.col(f"o.{key}").alias(key), F.explode(F.map_entries(F.map_zip_with(pack("o"), pack("n"), lambda k, a, b: F.struct(a.alias("old"), b.alias("new"))))).alias("c"))
    rows = pairs.select(key, F.col("c.key").alias("field"), F.col("c.value.old").alias("old"), F.col("c.value.new").alias("new"))
    short = lambda c: F.coalesce(F.length(c), F.lit(0)) < longest
    return rows.where(~F.col("old").eqNullSafe(F.col("new")) & short("old") & short("new"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def prune(rows: DataFrame, keys: list[str], at: str, reasons: DataFrame | None = None, row_key: str | None = None) -> DataFrame:
    """The last row of each key and day, and those whose `row_key` has a reason to stay."""
    w = Window.partitionBy(*keys, F.to_date(at)).orderBy(F.desc(at), *([F.desc(row_key)] if row_key else []))
    marked = rows.withColumn("_r", F.row_number().over(w))
    if reasons is None:
        return marked.where("_r = 1").drop("_r")
    kept = reasons.select(row_key).distinct().withColumn("_kept", F.lit(True))
    return marked.join(kept, row_key, "left").where("_r = 1 OR _kept").drop("_r", "_kept")


def embed_once(texts: DataFrame, cache: DataFrame, text: str, embed) -> DataFrame:
    """`texts` with `vec`: each distinct text by its SHA-1 from the cache, and the misses embedded once by `embed` (hash, text -> hash, vec)."""
    hashed = texts.withColumn("hash", F.sha1(F.col(text).cast("binary")))
    misses = hashed.select("hash", text).dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")
    return hashed.join(cache.select("hash", "vec").unionByName(embed(misses).select("hash", "vec")), "hash", "left")


def chunk_diff(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """(owner, idx, hash, action) by (owner, idx, hash): keep its vector, drop or add."""
    keys = [owner, "idx", "hash"]
    joined = old.select(*keys, F.lit(1).alias("_o")).join(new.select(*keys, F.lit(1).alias("_n")), keys, "full_outer")
    return joined.select(*keys, F.when(F.col("_o").isNull(), "add").when(F.col("_n").isNull(), "drop").otherwise("keep").alias("action"))


def drift(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows on one side only, and whether they are at least five and a fifth of the old ones."""
    joined = old.select(key, F.lit(1).alias("_o")).distinct().join(new.select(key, F.lit(1).alias("_n")).distinct(), key, "full_outer")
    sums = joined.agg(F.count_if(F.col("_o").isNull() | F.col("_n").isNull()).alias("moved"), F.count("_o").alias("had"))
    return sums.select("moved", (F.col("moved") >= F.greatest(F.lit(5), F.ceil(F.col("had") * 0.2))).alias("stale"))
