"""Queries of linkage and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.operators import evaluate, linkage, tasks
from loomfield.plans.registry import query
from loomfield.session import table


@query("r01_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, 1000000000 + l_partkey AS b FROM lineitem),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) USING KEY (node) AS (SELECT a, a FROM u UNION SELECT u.b, min(r.seen) FROM r JOIN u ON u.a = r.node LEFT JOIN recurring.r k ON k.node = u.b WHERE r.seen < coalesce(k.seen, 1e12) GROUP BY u.b)
    SELECT node, seen AS component FROM r""")
def components(spark, sf):
    return linkage.group(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (F.lit(1000000000) + F.col("l_partkey")).alias("b")))


@query("r01_component_sizes")
def sizes(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    edges = returned.select(F.col("l_orderkey").alias("a"), (F.lit(1000000000) + F.col("l_suppkey")).alias("b"))
    return linkage.group(edges).groupBy("component").agg(F.count("*").alias("n"))


@query("n24_capped_pairs", "WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), s AS (SELECT l_orderkey FROM o GROUP BY l_orderkey HAVING count(*) BETWEEN 2 AND 15) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM o a JOIN o b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey AND l_orderkey IN (SELECT l_orderkey FROM s) GROUP BY ALL")
def pairs(spark, sf):
    return linkage.capped_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", 15)


@query("n25_file_kin", """WITH o AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS f FROM lineitem), n AS (SELECT count(DISTINCT s) AS n FROM o), i AS (SELECT f, count(*) AS df, ln((max(n) + 1) / (count(*) + 1)) AS w FROM o, n GROUP BY f),
    r AS (SELECT * FROM o JOIN i USING (f)), t AS (SELECT s, sum(w) AS t FROM r GROUP BY s), b AS (SELECT a.s AS a, b.s AS b, sum(a.w) AS common FROM r a JOIN r b ON a.f = b.f AND a.s < b.s GROUP BY ALL)
    SELECT a, b, round(common / (x.t + y.t - common), 6) AS sim FROM b JOIN t x ON x.s = a JOIN t y ON y.s = b WHERE round(common / (x.t + y.t - common), 6) >= 0.25""")
def kin(spark, sf):
    return linkage.file_kin(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("n26_keys_in_text", "SELECT DISTINCT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = regexp_extract(c_name, '([0-9]+)', 1)::BIGINT")
def keys(spark, sf):
    named = table(spark, sf, "customer").select("c_custkey", F.explode(F.regexp_extract_all("c_name", F.lit("([0-9]+)"), F.lit(1))).alias("k"))
    o = table(spark, sf, "orders")
    return named.join(o, named.k.cast("long") == o.o_custkey).select("c_custkey", "o_orderkey").distinct()


@query("x50_pair_scores", """WITH f AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id), t AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.lang = b.lang AND a.doc_id < b.doc_id AND a.lang = 'en')
    SELECT round((SELECT count(*) FROM f JOIN t USING (a, b)) / (SELECT count(*) FROM f), 6) AS precision, round((SELECT count(*) FROM f JOIN t USING (a, b)) / (SELECT count(*) FROM t), 6) AS recall,
        round(2 * (SELECT count(*) FROM f JOIN t USING (a, b)) / ((SELECT count(*) FROM f) + (SELECT count(*) FROM t)), 6) AS f1""")
def pair_scores(spark, sf):
    d = table(spark, sf, "documents").select(F.sha1(F.col("text").cast("binary")).alias("h"), "lang", "doc_id")
    pairs = d.select("h", F.col("doc_id").alias("a"), F.col("lang").alias("la")).join(d.select("h", F.col("doc_id").alias("b"), F.col("lang").alias("lb")), "h").where("a < b")
    return evaluate.pair_scores(pairs, pairs.where("la = lb AND la = 'en'"), ["a", "b"])


@query("q14_tasks")
def work_tasks(spark, sf):
    """Orders as sessions, customers as tickets, suppliers as branches, parts as files, conversations as collected items."""
    o = table(spark, sf, "orders")
    k, at = F.col("o_orderkey"), F.unix_timestamp("o_orderdate")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    first = line.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("supplier"))
    o = o.join(first, "o_orderkey", "left")
    branch = F.when(k % 4 == 0, "main").when(k % 9 == 1, F.concat(F.lit("feat/cu-"), "o_custkey")).otherwise(F.concat(F.lit("s"), "supplier"))
    title = F.concat_ws(" ", F.when(k % 7 == 0, F.concat(F.lit("CU-"), "o_custkey")), F.lit("work on"), F.concat(F.lit("part"), F.col("o_custkey") % 500), F.concat(F.lit("crowd"), F.col("o_custkey") % 50))
    sessions = o.select(k.alias("id"), F.concat(F.lit("/r"), F.col("o_custkey") % 10).alias("repo"), branch.alias("branch"), title.alias("title"), at.alias("started"), (at + 3600).alias("updated"))
    said = o.where(k % 3 == 0).select(k.alias("id"), F.concat(F.lit("CU-"), "o_custkey").alias("key"), F.lit(2).alias("n"))
    edits = line.where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("path"))
    commits = o.where(k % 11 == 0).select(F.concat(F.lit("/r"), F.col("o_custkey") % 10).alias("repo"), F.concat(F.lit("c"), k).alias("sha"), at.alias("at"), F.concat(F.lit("CU-"), "o_custkey", F.lit(": fix")).alias("subject"), (k % 2 == 0).alias("mine"))
    c = table(spark, sf, "customer")
    items = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("CU-"), "c_custkey")).alias("key"), F.lit(None).cast("string").alias("branch"), F.col("c_name").alias("title"), F.concat(F.lit("see CU-"), F.col("c_custkey") + 1, F.lit(" and XX-1")).alias("text"), F.lit(0).cast("long").alias("at"), (F.col("c_custkey") % 10 == 0).alias("pr"), (F.col("c_custkey") % 2 == 0).alias("mine"))
    return tasks.group_work(sessions, said, edits, commits, items).cards
