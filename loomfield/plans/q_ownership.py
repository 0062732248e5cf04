"""Queries of ownership and expertise; lineitem stands for blame."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomfield.operators import ownership as own
from loomfield.plans.fixtures import OWNERS_SQL, owners
from loomfield.plans.registry import query
from loomfield.session import table


def _now() -> Column:
    return F.to_timestamp(F.lit("2001-06-01"))

NOW_SQL = "TIMESTAMP '2001-06-01'"
_GONE = f"gone AS (SELECT author, max(made) < {NOW_SQL} - INTERVAL 90 DAY AS gone FROM owners GROUP BY author)"
_OWN = "own AS (SELECT area, author, sum(lines)::BIGINT AS lines, count(DISTINCT file) AS files, max(made) AS last FROM owners GROUP BY ALL), shared AS (SELECT *, lines / sum(lines) OVER (PARTITION BY area) AS share FROM own)"


@query("a04_owners", f"WITH {OWNERS_SQL}, {_OWN} SELECT area, author, lines, files, round(share, 6) AS share FROM shared")
def by_author(spark, sf):
    return own.by_author(owners(spark, sf)).select("area", "author", "lines", "files", F.round("share", 6).alias("share"))


@query("a04_top_owner", f"WITH {OWNERS_SQL}, {_OWN} SELECT area, author, lines FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY lines DESC, author) AS r FROM own) WHERE r = 1")
def top_owner(spark, sf):
    rows = own.by_author(owners(spark, sf))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("lines"), "author"))).where("r = 1").select("area", "author", "lines")


@query("a02_merge_maps", "SELECT l_partkey AS file, l_suppkey AS author, sum(l_quantity)::BIGINT AS lines FROM lineitem GROUP BY ALL")
def merge_maps(spark, sf):
    line = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("file"), "l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("lines"))
    chunks = line.groupBy("l_orderkey", "file").agg(F.map_from_entries(F.collect_list(F.struct("l_suppkey", "lines"))).alias("authors"))
    return own.from_maps(chunks, "file", "authors")


@query("a08_departed", f"WITH {OWNERS_SQL}, {_GONE} SELECT author, gone FROM gone")
def departed(spark, sf):
    return own.departed(own.last_seen(owners(spark, sf)), _now())


_HEALTH = f"""WITH {OWNERS_SQL}, {_GONE}, {_OWN}, h AS (
    SELECT area, sum(lines)::BIGINT AS lines, sum(CASE WHEN gone THEN lines ELSE 0 END) / sum(lines) AS departed_share,
        sum((NOT gone AND share >= 0.1)::INT)::BIGINT AS bus_factor, date_diff('day', max(last)::DATE, {NOW_SQL}::DATE) AS age_days,
        arg_max(author, CASE WHEN NOT gone THEN lines * 1000000 - author END) AS ask FROM shared JOIN gone USING (author) GROUP BY area)"""
_RISK = "round(least(1.0, 0.6 * departed_share + 0.25 * least(1.0, age_days / 730.0) + CASE WHEN bus_factor = 0 THEN 0.15 ELSE 0 END), 3)"


@query("a09_knowledge_gaps", f"{_HEALTH} SELECT area, lines, round(departed_share, 6) AS departed_share, bus_factor, ask FROM h ORDER BY lines * departed_share DESC, area LIMIT 40")
def gaps(spark, sf):
    rows = _health(spark, sf).orderBy(F.desc(F.col("lines") * F.col("departed_share")), "area").limit(40)
    return rows.select("area", "lines", F.round("departed_share", 6).alias("departed_share"), "bus_factor", "ask")


@query("a10_area_health", f"{_HEALTH} SELECT area, age_days::INT AS age_days, {_RISK} AS risk, round({_RISK} * log10(greatest(10, lines)), 5) AS rank FROM h")
def area_health(spark, sf):
    return _health(spark, sf).select("area", "age_days", "risk", F.round("rank", 5).alias("rank"))


def _health(spark, sf):
    rows = owners(spark, sf)
    return own.health(rows, own.departed(own.last_seen(rows), _now()), _now())


_HITS = "hits AS (SELECT l AS file, s AS sim FROM (SELECT p_partkey AS l, (p_size - 10) / 50.0 AS s FROM part))"


@query("a05_experts", f"""WITH {OWNERS_SQL}, {_HITS}, w AS (SELECT author, sum(greatest(sim, 0.0) * lines) AS weight FROM hits JOIN owners USING (file) GROUP BY author)
    SELECT author, round(weight, 4) AS weight, round(weight / (SELECT sum(weight) FROM w), 6) AS share FROM w ORDER BY weight DESC, author LIMIT 8""")
def experts(spark, sf):
    hits = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), ((F.col("p_size") - 10) / 50.0).alias("sim"))
    return own.experts(hits, owners(spark, sf)).select("author", F.round("weight", 4).alias("weight"), F.round("share", 6).alias("share"))


@query("a06_experts_by_path", f"WITH {OWNERS_SQL} SELECT author, sum(lines)::BIGINT AS lines FROM owners WHERE dir LIKE '%STEEL%' GROUP BY author ORDER BY lines DESC, author LIMIT 8")
def experts_by_path(spark, sf):
    rows = owners(spark, sf).where(F.contains("dir", F.lit("STEEL"))).groupBy("author").agg(F.sum("lines").alias("lines"))
    return rows.orderBy(F.desc("lines"), "author").limit(8)


@query("n23_shared_files", """WITH o AS (SELECT l_orderkey AS file, l_suppkey AS author, sum(l_quantity)::BIGINT AS lines FROM lineitem GROUP BY ALL),
    s AS (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM o)
    SELECT a.author AS a, b.author AS b, count(*) AS files, sum(least(a.lines, b.lines))::BIGINT AS lines FROM s a JOIN s b USING (file) WHERE a.n BETWEEN 2 AND 12 AND a.author < b.author GROUP BY ALL""")
def shared(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("author"), F.col("l_quantity").cast("long").alias("lines"))
    return own.shared_files(rows)


@query("n22_overlaps", """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL), v AS (SELECT label, list(m ORDER BY i) AS v FROM m GROUP BY label)
    SELECT 'area' || a.label AS a, 'area' || b.label AS b, round(list_inner_product(a.v, b.v), 6) AS sim FROM v a JOIN v b ON 'area' || a.label < 'area' || b.label ORDER BY sim DESC, a, b LIMIT 15""")
def overlaps(spark, sf):
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("v"))
    return own.overlaps(vectors.select(F.concat(F.lit("area"), F.col("label").cast("string")).alias("area"), "v"), "area", F.col("v"))


@query("a11_team", """SELECT l_suppkey AS author, count(*) AS commits, sum(l_quantity)::BIGINT AS added, count(DISTINCT l_partkey) AS files, count(DISTINCT date_trunc('week', l_shipdate)) AS weeks, max(l_shipdate) AS last FROM lineitem GROUP BY author""")
def team(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("author")).agg(
        F.count("*").alias("commits"), F.sum(F.col("l_quantity").cast("long")).alias("added"), F.count_distinct("l_partkey").alias("files"),
        F.count_distinct(F.date_trunc("week", "l_shipdate")).alias("weeks"), F.max("l_shipdate").alias("last"),
    )


@query("w07_newest_n", "SELECT l_suppkey AS author, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 15")
def newest(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 15").select(F.col("l_suppkey").alias("author"), "l_orderkey", "l_linenumber")


@query("w08_most_common", "SELECT l_suppkey AS author, p_brand AS area, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS r FROM (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE r <= 3")
def common(spark, sf):
    counts = owners(spark, sf).groupBy("author", "area").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("n"), "area"))).where("r <= 3").drop("r")


@query("a24_modal_area", "WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT l_suppkey AS author, min(p_brand) AS area FROM c WHERE n = (SELECT max(n) FROM c d WHERE d.l_suppkey = c.l_suppkey) GROUP BY author")
def modal(spark, sf):
    counts = owners(spark, sf).groupBy("author", "area").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.rank().over(Window.partitionBy("author").orderBy(F.desc("n")))).where("r = 1")
    return ranked.groupBy("author").agg(F.min("area").alias("area"))


@query("a36_claims", """SELECT l_partkey AS file, arg_max(l_suppkey, (epoch(l_shipdate)::HUGEINT * 1000000 + l_suppkey)) AS holder, count(*) AS lines FROM lineitem GROUP BY file""")
def claims(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.max_by("l_suppkey", F.struct("l_shipdate", "l_suppkey")).alias("holder"), F.count("*").alias("lines"))


@query("a30_top_share", f"WITH {OWNERS_SQL}, {_OWN} SELECT area, author FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY lines DESC, author) AS r, count(*) OVER (PARTITION BY area) AS people FROM shared) WHERE r = 1 AND lines >= 10 AND share >= 0.01 AND people >= 2")
def top_share(spark, sf):
    w = Window.partitionBy("area")
    rows = own.by_author(owners(spark, sf)).withColumns({"r": F.row_number().over(w.orderBy(F.desc("lines"), "author")), "people": F.count("*").over(w)})
    return rows.where("r = 1 AND lines >= 10 AND share >= 0.01 AND people >= 2").select("area", "author")
