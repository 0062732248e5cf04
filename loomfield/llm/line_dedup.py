"""Line deduplication by site-relative frequency.

A line's share is the number of its host's pages that contain it, divided by all pages of the host. Lines
whose share exceeds the boilerplate ratio are dropped from that host's pages. All in DataFrame
operations: lines travel as hashes, are counted before the shuffle, and a host's dropped lines are at
most (mean distinct lines a page) / ratio, so a host's set is small however many pages it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import fresh, materialize

RATIO = 0.1
#: A line on fewer pages of a host stays, whatever its share.
MIN_PAGES = 5
#: A host's rows are dealt out over so many keys when its set of lines is joined back.
SALTS = 64
BLANKS = " \t\r"


def _key(line: Column) -> Column:
    """Two 64-bit hashes in one string would be slow; one hash and the length tell lines apart."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.xxhash64(bare, F.length(bare)))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, for hosts that have some."""
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text")).where("host is not null")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    own = F.array_distinct(F.transform(F.split("text", "\n", -1), _key))
    found = pages.select("host", F.explode(own).alias("line")).where("line is not null")
    often = found.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    rated = often.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return rated.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """`docs` with the boilerplate lines taken out of `text_col`, and `n_lines` and `n_dropped`.

    Lines end at \\n and are compared without spaces, tabs and carriage returns at their ends; lines that
    are blank stay. A page counts once for a line it repeats, and every repeat is dropped. Repeated rows
    are pages of their own; columns of these two names are replaced, others may have any name. A null text stays null with no lines,
    and rows without a host stay as they are. A page may end up empty; its row stays.
    """
    host, found, salt, row_salt, left = (fresh(docs, n) for n in ("_host", "_lines", "_salt", "_row_salt", "_kept"))
    known = materialize(boilerplate(docs, host_col, text_col, ratio, min_pages))
    known = known.select(F.col("host").alias(host), F.col("lines").alias(found), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    rows = docs.select("*", F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(SALTS)).cast("int").alias(row_salt))
    # The planner broadcasts the sets if the written table is below its threshold, else it joins on the salted host.
    joined = rows.join(known, (F.col(host_col) == F.col(host)) & (F.col(row_salt) == F.col(salt)), "left")
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    kept = F.when(F.col(found).isNotNull(), F.filter(lines, lambda x: ~F.coalesce(F.array_contains(found, _key(x)), F.lit(False)))).otherwise(lines)
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    out = joined.select(*others, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), kept.alias(left))
    out = out.withColumn("n_dropped", F.when(F.col(left).isNotNull(), F.col("n_lines") - F.size(left)).otherwise(0))
    return out.withColumn(text_col, F.array_join(left, "\n")).drop(left)
