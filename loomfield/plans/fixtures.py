"""Stand-ins for the engine's tables, made from the supplied ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.session import table


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """documents as files: path, title, author and time made from ids and source."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", "text", "lang", "source", "n_chars",
        F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt")).alias("path"),
        F.concat(F.lit("user"), (F.col("doc_id") % 17).cast("string")).alias("author"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id % 300 AS int))").alias("at"),
        F.when(F.col("doc_id") % 2 == 0, "file").otherwise("code").alias("kind"),
    )


#: The same in SQL, as a common table expression `corpus`.
CORPUS_SQL = """corpus AS (
    SELECT doc_id, text, lang, source, n_chars,
        'src/' || source || '/' || lang || '/doc' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS path,
        'user' || (doc_id % 17) AS author,
        TIMESTAMP '2024-01-01' + to_days((doc_id % 300)::INT) AS made,
        CASE WHEN doc_id % 2 = 0 THEN 'file' ELSE 'code' END AS kind
    FROM documents)"""


def owners(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as blame: part = file, its brand = area, supplier = author, quantity = lines, ship date = time."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_partkey").alias("file"), F.col("p_brand").alias("area"), F.col("p_type").alias("dir"), F.col("l_suppkey").alias("author"),
        F.col("l_quantity").cast("long").alias("lines"), F.col("l_shipdate").alias("at"),
    )


OWNERS_SQL = """owners AS (
    SELECT l_partkey AS file, p_brand AS area, p_type AS dir, l_suppkey AS author, CAST(l_quantity AS BIGINT) AS lines, l_shipdate AS made
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""
