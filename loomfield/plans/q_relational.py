"""Queries of joins, set operations and state writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfield.operators import linkage, state
from loomfield.plans.fixtures import CORPUS_SQL, corpus
from loomfield.plans.registry import query
from loomfield.session import table
from loomfield.functions import text as tx


@query("n01_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


@query("n02_inner_then_left", "SELECT c_custkey, n_name, count(o_orderkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY ALL")
def inner_left(spark, sf):
    c, n, o = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "orders").where("o_totalprice > 200000")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(o, o.o_custkey == c.c_custkey, "left").groupBy("c_custkey", "n_name").agg(F.count("o_orderkey").alias("n"))


@query("n04_left_group", "SELECT p_partkey, count(l_orderkey) AS n, max(l_shipdate) AS last FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def left_group(spark, sf):
    p, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    return p.join(line, p.p_partkey == line.l_partkey, "left").groupBy("p_partkey").agg(F.count("l_orderkey").alias("n"), F.max("l_shipdate").alias("last"))


@query("n06_inner_distinct", "SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def inner_distinct(spark, sf):
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return o.join(line, o.o_orderkey == line.l_orderkey).select("o_custkey", "l_suppkey").distinct()


@query("n09_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'O'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("n10_latest_per_key", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest(spark, sf):
    return state.latest(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("n11_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("n12_anti_composite", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_returnflag = 'N' AND m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey)")
def anti_composite(spark, sf):
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return line.where("l_returnflag = 'A'").join(line.where("l_returnflag = 'N'"), ["l_partkey", "l_suppkey"], "left_anti").select("l_partkey", "l_suppkey").distinct()


@query("n14_longest_prefix", f"""WITH {CORPUS_SQL}, roots AS (SELECT DISTINCT 'src/' || source AS root FROM documents UNION SELECT DISTINCT 'src/' || source || '/' || lang FROM documents WHERE lang <> 'en' UNION SELECT 'src')
    SELECT doc_id, arg_max(root, length(root)) AS root FROM corpus JOIN roots ON starts_with(path, root || '/') GROUP BY doc_id""")
def longest_prefix(spark, sf):
    d = table(spark, sf, "documents")
    base = F.concat(F.lit("src/"), "source")
    roots = d.select(base.alias("root")).union(d.where("lang <> 'en'").select(F.concat(base, F.lit("/"), "lang"))).union(d.select(F.lit("src"))).distinct()
    above = corpus(spark, sf).select("doc_id", F.explode(tx.ancestors(F.col("path"))).alias("root"))
    return above.join(roots, "root").groupBy("doc_id").agg(F.max_by("root", F.length("root")).alias("root"))


@query("n16_interval_join", "SELECT o_orderkey, count(*) AS shipped FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate - INTERVAL 300 SECOND AND l_shipdate <= o_orderdate + INTERVAL 20 DAY GROUP BY o_orderkey")
def interval(spark, sf):
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    near = (line.l_shipdate >= o.o_orderdate - F.expr("INTERVAL 300 SECONDS")) & (line.l_shipdate <= o.o_orderdate + F.expr("INTERVAL 20 DAYS"))
    return o.join(line, (o.o_orderkey == line.l_orderkey) & near).groupBy("o_orderkey").agg(F.count("*").alias("shipped"))


@query("n17_band_self_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'purchase' AND a.event_id < b.event_id AND abs(epoch(a.ts) - epoch(b.ts)) <= 86400")
def band(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return linkage.band_pairs(e, "event_id", "user_id", "us", 86_400_000_000)


@query("n18_half_of_words", """WITH w AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[\\p{L}\\p{N}]+')) AS w FROM pages), n AS (SELECT page_id, count(*) AS n FROM w GROUP BY page_id),
    c AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS common FROM w a JOIN w b ON a.w = b.w AND a.page_id < b.page_id GROUP BY ALL)
    SELECT a, b FROM c JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE 2 * common >= x.n + y.n - common""")
def half_of_words(spark, sf):
    own = table(spark, sf, "pages").select("page_id", F.array_distinct(tx.words(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("ws"))
    return linkage.alike_sets(own, "page_id", "ws")


@query("n19_reference_join", "SELECT l_partkey, o_custkey, min(o_orderkey) AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def references(spark, sf):
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(line, o.o_orderkey == line.l_orderkey).groupBy("l_partkey", "o_custkey").agg(F.min("o_orderkey").alias("first"))


@query("n20_content_join", "SELECT a.doc_id AS a, min(b.doc_id) AS first FROM documents a JOIN documents b ON sha1(a.text) = sha1(b.text) GROUP BY a.doc_id")
def content(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("hash"))
    firsts = d.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return d.join(firsts, "hash").select(F.col("doc_id").alias("a"), "first")


@query("n27_override_as_of", "SELECT o_orderkey, CASE WHEN m.at >= o_orderdate THEN 'manual' ELSE o_orderstatus END AS state FROM orders LEFT JOIN (SELECT c_custkey, TIMESTAMP '1998-01-01' AS at FROM customer WHERE c_acctbal > 5000) m ON m.c_custkey = o_custkey")
def override(spark, sf):
    manual = table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey", F.to_timestamp(F.lit("1998-01-01")).alias("at"))
    o = table(spark, sf, "orders")
    return o.join(manual, o.o_custkey == manual.c_custkey, "left").select("o_orderkey", F.when(F.col("at") >= F.col("o_orderdate"), "manual").otherwise(F.col("o_orderstatus")).alias("state"))


@query("u02_intersection", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersection(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")).intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("u03_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def difference(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).exceptAll(table(spark, sf, "orders").where("o_totalprice > 100000").select("o_custkey").distinct())


@query("u04_drift", "WITH o AS (SELECT doc_id FROM documents WHERE n_chars > 500), m AS (SELECT count(*) AS moved FROM documents WHERE (n_chars > 500) <> (lang <> 'de')) SELECT moved, moved >= greatest(5, ceil((SELECT count(*) FROM o) * 0.2)) AS stale FROM m")
def drift(spark, sf):
    d = table(spark, sf, "documents")
    return state.drift(d.where("n_chars > 500"), d.where("lang <> 'de'"), "doc_id")


@query("u05_corpora_merge", "SELECT 'document' AS kind, doc_id AS id, length(text) AS size FROM documents UNION ALL SELECT 'page', page_id, length(html) FROM pages UNION ALL SELECT 'turn', conv_id * 100 + turn, length(text) FROM conversations")
def merge(spark, sf):
    size = lambda c: F.length(c).cast("long").alias("size")
    rows = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), size("text"))
    rows = rows.unionByName(table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), size("html")))
    return rows.unionByName(table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), size("text")))


@query("u06_prepend", "SELECT doc_id, min(p) AS priority FROM (SELECT doc_id, 0 AS p FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 1 FROM documents WHERE n_chars > 2000) GROUP BY doc_id")
def prepend(spark, sf):
    d = table(spark, sf, "documents")
    first, rest = d.where("lang = 'de'").select("doc_id", F.lit(0).alias("priority")), d.where("n_chars > 2000").select("doc_id", F.lit(1).alias("priority"))
    return first.unionByName(rest.join(first, "doc_id", "left_anti"))


_OLD, _NEW = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0", "SELECT c_custkey, c_name || '!' AS c_name, round(c_acctbal + c_nationkey - 9, 2) AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'"


def _sides(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    new = c.where("c_mktsegment <> 'BUILDING'").withColumns({"c_name": F.concat("c_name", F.lit("!")), "c_acctbal": F.round(F.col("c_acctbal") + F.col("c_nationkey") - 9, 2)})
    return c.where("c_acctbal > 0").drop("c_nationkey"), new.drop("c_nationkey")


@query("k02_upsert", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal WHEN o.c_custkey IS NULL THEN n.c_acctbal ELSE greatest(o.c_acctbal, n.c_acctbal) END AS c_acctbal, CASE WHEN n.c_custkey IS NULL THEN o.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def upsert(spark, sf):
    return state.upsert(*_sides(spark, sf), ["c_custkey"], keep=("c_name",), greatest=("c_acctbal",))


@query("k01_insert_ignore", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def ignore(spark, sf):
    return state.insert_ignore(*_sides(spark, sf), ["c_custkey"])


@query("k04_change_rows", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT o.c_custkey, 'c_name' AS field, o.c_name AS \"old\", n.c_name AS \"new\" FROM o JOIN n USING (c_custkey) WHERE o.c_name <> n.c_name")
def changes(spark, sf):
    return state.change_rows(*_sides(spark, sf), "c_custkey", ["c_name", "c_mktsegment"])


@query("k07_sync_plan", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'add' WHEN n.c_custkey IS NULL THEN 'gone' ELSE 'update' END AS action FROM o FULL JOIN n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR sha1(o.c_acctbal::VARCHAR) <> sha1(n.c_acctbal::VARCHAR)")
def sync(spark, sf):
    digest = F.sha1(F.col("c_acctbal").cast("string").cast("binary"))
    return state.changed(*[x.withColumn("hash", digest) for x in _sides(spark, sf)], "c_custkey")


@query("k08_distinct_texts", "SELECT sha1(text) AS hash, count(*) AS n FROM documents GROUP BY hash")
def texts(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("hash")).agg(F.count("*").alias("n"))


@query("k10_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("k13_prune", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 OR event_type = 'signup'")
def prune(spark, sf):
    e = table(spark, sf, "events")
    return state.prune(e, ["user_id"], "ts", e.where("event_type = 'signup'"), "event_id").select("event_id")


@query("a01_counts", "SELECT lang, source, count(*) AS n, count(DISTINCT n_chars) AS sizes, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY ALL")
def counts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_distinct("n_chars").alias("sizes"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("a03_newest_groups", "SELECT conv_id, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY conv_id ORDER BY last DESC, conv_id LIMIT 20")
def newest(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    return rows.orderBy(F.desc("last"), "conv_id").limit(20)


@query("a40_distinct_keep_first", "SELECT text, min(doc_id) AS first FROM documents GROUP BY text")
def keep_first(spark, sf):
    return table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("first"))


@query("w12_filter_then_limit", "SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars > 500 ORDER BY n_chars, doc_id LIMIT 30")
def filter_limit(spark, sf):
    return table(spark, sf, "documents").where("lang = 'fr' AND n_chars > 500").orderBy("n_chars", "doc_id").limit(30).select("doc_id")


@query("x11_merge_newest_field", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderpriority <> '5-LOW') AS priority FROM orders GROUP BY o_custkey")
def merge_newest(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey"))).alias("priority"))


@query("x20_top_n_and_overflow", "SELECT l_partkey, count(*) FILTER (WHERE r <= 10) AS shown, greatest(count(*) - 10, 0) AS more FROM (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS r FROM lineitem) GROUP BY l_partkey")
def overflow(spark, sf):
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_partkey", F.row_number().over(w).alias("r"))
    return rows.groupBy("l_partkey").agg(F.count_if(F.col("r") <= 10).alias("shown"), F.greatest(F.count("*") - 10, F.lit(0)).cast("long").alias("more"))


@query("x25_states", "SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'done' WHEN bool_or(o_orderstatus = 'O') THEN 'open' ELSE 'loose' END AS state FROM orders GROUP BY o_custkey")
def states(spark, sf):
    done, opened = F.bool_and(F.col("o_orderstatus") == "F"), F.bool_or(F.col("o_orderstatus") == "O")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.when(done, "done").when(opened, "open").otherwise("loose").alias("state"))


@query("x39_grouped_children", "SELECT o_custkey, count(*) AS n, array_to_string(list(o_orderkey::VARCHAR ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY o_custkey")
def children(spark, sf):
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), keys.alias("keys"))


@query("x42_signature", "SELECT lang, sha1(to_json(list(doc_id ORDER BY doc_id))::VARCHAR) AS signature FROM documents GROUP BY lang")
def signature(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.sha1(F.to_json(F.array_sort(F.collect_list("doc_id"))).cast("binary")).alias("signature"))
