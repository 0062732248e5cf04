"""Further queries of ranking, people, work and topics."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.operators import cluster, people, search, work
from loomfield.plans.fixtures import CORPUS_SQL, OWNERS_SQL, corpus, owners
from loomfield.plans.registry import query
from loomfield.session import table

_QV = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_SIM = "round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 6)"


def _now() -> Column:
    return F.to_timestamp(F.lit("2001-07-01"))


@query("q02_code_rank", f"""WITH {CORPUS_SQL}, e AS (SELECT vec_id, {_SIM} AS sim FROM embeddings, {_QV}), c AS (SELECT doc_id, text, sim, (len(text) - len(replace(lower(text), 'of the', ''))) / 6 AS bm FROM corpus JOIN e ON vec_id = doc_id),
    b AS (SELECT *, (sim - avg(sim) OVER ()) / (stddev_pop(sim) OVER () + 1e-9) + 0.2 * (bm - avg(bm) OVER ()) / (stddev_pop(bm) OVER () + 1e-9) AS z, (length(text) - length(replace(lower(text), 'of the', ''))) / 6 AS n, count(*) FILTER (WHERE contains(text, 'thing')) OVER () AS h FROM c)
    SELECT doc_id, round(z + CASE WHEN n > 0 THEN 3 + ln(1 + n) + contains(text, 'of the')::INT ELSE 0 END + CASE WHEN contains(text, 'thing') THEN 2 / log2(1.0 + h) ELSE 0 END, 4) AS rank_score FROM b""")
def code_rank(spark, sf):
    from loomfield.plans.q_search import _vector

    sims = search.similarities(table(spark, sf, "embeddings"), _vector(spark, sf), "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    bm = ((F.length("text") - F.length(F.replace(F.lower("text"), F.lit("of the"), F.lit("")))) / 6).alias("bm")
    rows = corpus(spark, sf).join(sims, "doc_id").select("doc_id", "text", "path", "sim", bm)
    return search.code_rank(rows, "doc_id", phrase="of the", name="thing").select("doc_id", F.round("rank_score", 4).alias("rank_score"))


@query("x04_path_match", f"WITH {CORPUS_SQL} SELECT doc_id, (list_contains(regexp_extract_all(path, '[a-z0-9]+'), 'en')::INT / 2.0 + (regexp_matches(path, '/src1[0-9]*/'))::INT / 2.0)::DOUBLE AS cover FROM corpus")
def path_match(spark, sf):
    return corpus(spark, sf).select("doc_id", search.path_match(F.col("path"), ["en", "src1"]).alias("cover"))


@query("j03_focus_line")
def focus(spark, sf):
    best = search.focus_line(F.col("text"), ["thing", "there"], "of the", "thing")
    return table(spark, sf, "documents").select("doc_id", best.alias("b")).select("doc_id", "b.n", "b.score", "b.line")


@query("j05_top_author", "SELECT l_partkey AS file, max(l_quantity)::BIGINT AS lines FROM lineitem GROUP BY file")
def top_author(spark, sf):
    maps = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.collect_list(F.struct(F.col("l_quantity").cast("long").alias("lines"), F.col("l_suppkey").alias("who"))).alias("authors"))
    return maps.select("file", F.array_max("authors")["lines"].alias("lines"))


@query("j08_topic_text", "SELECT p_partkey, lower(regexp_replace(p_name, '[_/.-]+', ' ', 'g')) AS text FROM part")
def topic_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", "[_/.-]+", " ")).alias("text"))


@query("j09_lines", f"WITH {CORPUS_SQL} SELECT doc_id, kind || '  ' || path || '  ' || author AS line FROM corpus")
def lines(spark, sf):
    return corpus(spark, sf).select("doc_id", F.concat_ws("  ", "kind", "path", "author").alias("line"))


@query("j01_uniform_rows", "SELECT 'doc' AS kind, doc_id AS id, source AS title, lang AS subtitle FROM documents UNION ALL SELECT 'page', page_id, url, NULL FROM pages UNION ALL SELECT 'session', conv_id, NULL, role FROM conversations WHERE turn = 0")
def uniform(spark, sf):
    rows = table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("subtitle"))
    rows = rows.unionByName(table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("title")), True)
    return rows.unionByName(table(spark, sf, "conversations").where("turn = 0").select(F.lit("session").alias("kind"), F.col("conv_id").alias("id"), F.col("role").alias("subtitle")), True)


@query("n08_postings_with_residual", "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'thing') AND contains(lower(text), 'of the')")
def residual(spark, sf):
    docs = table(spark, sf, "documents")
    terms = search.postings(docs, "doc_id", F.col("text")).where("term = 'thing'").select(F.col("id").alias("doc_id"))
    return docs.join(terms, "doc_id", "left_semi").where(F.lower("text").contains("of the")).select("doc_id")


@query("n05_left_files", "SELECT c_custkey, count(DISTINCT o_orderpriority) AS kinds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_files(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count_distinct("o_orderpriority").alias("kinds"))


@query("n28_existing_checkout", "SELECT l_orderkey, l_linenumber, p_partkey IS NOT NULL AND p_size > 25 AS own FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def existing(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return line.join(part, line.l_partkey == part.p_partkey, "left").select("l_orderkey", "l_linenumber", (F.col("p_partkey").isNotNull() & (F.col("p_size") > 25)).alias("own"))


@query("a07_blame_areas", f"WITH {OWNERS_SQL} SELECT area, author, sum(lines)::BIGINT AS lines, max(made) AS newest, count(DISTINCT file) FILTER (WHERE lines > 25) AS big FROM owners GROUP BY ALL")
def blame_areas(spark, sf):
    return owners(spark, sf).groupBy("area", "author").agg(F.sum("lines").alias("lines"), F.max("at").alias("newest"), F.count_distinct(F.when(F.col("lines") > 25, F.col("file"))).alias("big"))


@query("a16_peers", """WITH c AS (SELECT l_suppkey AS person, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY person), r AS (SELECT *, rank() OVER (ORDER BY n DESC) AS place, count(*) OVER (PARTITION BY n) AS same, count(*) OVER () AS total FROM c)
    SELECT person, n, place, round(100 * (total - place - same + 1 + 0.5 * same) / total, 6) AS percentile FROM r""")
def peers(spark, sf):
    counts = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("person")).agg(F.count("*").alias("n"))
    return people.peers(counts, "person", "n").select("person", "n", F.col("place").cast("long").alias("place"), F.round("percentile", 6).alias("percentile"))


@query("a23_deployed", "SELECT p_brand AS repo, sum(CASE WHEN p_size % 5 <> 0 THEN l_quantity ELSE 0 END)::BIGINT AS lines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY repo")
def deployed(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    path = F.when(F.col("p_size") % 5 == 0, "web/dist/app.js").otherwise("web/src/app.js")
    rows = line.join(part, line.l_partkey == part.p_partkey).withColumn("path", path)
    return rows.groupBy(F.col("p_brand").alias("repo")).agg(F.sum(F.when(tx.is_deployed(F.col("path")), F.col("l_quantity").cast("long")).otherwise(0)).alias("lines"))


@query("a29_approvals", "SELECT l_suppkey AS reviewer, round(sum(pow(0.5, (epoch(TIMESTAMP '2001-07-01') - epoch(l_shipdate)) / 86400 / 365)), 5) AS approved, min(l_shipdate) AS first, arg_max(l_returnflag, epoch(l_shipdate) * 1000 + ascii(l_returnflag)) AS title FROM lineitem GROUP BY reviewer")
def approvals(spark, sf):
    age = (F.unix_seconds(_now()) - F.unix_seconds(F.col("l_shipdate").cast("timestamp"))) / 86400
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("reviewer")).agg(
        F.round(F.sum(F.pow(F.lit(0.5), age / 365)), 5).alias("approved"), F.min("l_shipdate").alias("first"), F.max_by("l_returnflag", F.struct("l_shipdate", "l_returnflag")).alias("title")
    )


@query("a32_decayed_pairs", """WITH p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, a.l_returnflag AS f FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey AND a.l_returnflag = b.l_returnflag),
    u AS (SELECT a, b, 0.01 * count(*) AS n FROM p WHERE f = 'A' GROUP BY ALL UNION ALL SELECT a, b, count(*)::DOUBLE FROM p WHERE f = 'R' GROUP BY ALL) SELECT a, b, round(sum(n), 6)::DOUBLE AS n FROM u GROUP BY ALL HAVING sum(n) >= 0.05""")
def decayed(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    p = line.withColumnRenamed("l_suppkey", "a").join(line.withColumnRenamed("l_suppkey", "b"), ["l_orderkey", "l_returnflag"]).where("a < b").groupBy("a", "b", "l_returnflag").agg(F.count("*").alias("n"))
    return people.decayed_pairs(p.where("l_returnflag = 'A'"), p.where("l_returnflag = 'R'"), 0.01).select("a", "b", F.round("n", 6).alias("n"))


@query("a39_best_for", "SELECT o_orderpriority AS project, o_custkey AS person, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_custkey) AS r FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL)) WHERE r <= 3")
def best_for(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("project"), F.col("o_custkey").alias("person")).agg(F.count("*").alias("n"))
    return search.best_per_key(counts, "project", [F.desc("n"), F.col("person")], 3)


@query("w11_first_review", "SELECT l_suppkey AS reviewer, p_brand AS repo, min(l_shipdate) AS first FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def first_review(spark, sf):
    return owners(spark, sf).groupBy(F.col("author").alias("reviewer"), F.col("area").alias("repo")).agg(F.min("at").alias("first"))


@query("w14_closest_first", "SELECT o_custkey, n_left FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_left, max(o_orderdate) AS updated FROM orders GROUP BY o_custkey) ORDER BY n_left = 0, n_left, updated DESC, o_custkey LIMIT 50")
def closest(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "F").alias("n_left"), F.max("o_orderdate").alias("updated"))
    return rows.orderBy(F.col("n_left") == 0, "n_left", F.desc("updated"), "o_custkey").limit(50).select("o_custkey", "n_left")


@query("r10_join_nearest", """WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label)
    SELECT vec_id, label, sim FROM (SELECT vec_id, c.label, round(list_inner_product(embedding::DOUBLE[], c.c), 6) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(embedding::DOUBLE[], c.c), 6) DESC, c.label) AS r FROM embeddings, c) WHERE r = 1""")
def join_nearest(spark, sf):
    e = table(spark, sf, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("c"))
    return cluster.join_nearest(e.select("vec_id", "embedding"), centres, "vec_id", "embedding", "label", "c")


@query("x51_average_linkage")
def average_linkage(spark, sf):
    """Users by how often they act with the same key on the same day; every fiftieth user and the next one are forced together."""
    from loomfield.operators.agglomerate import average_linkage as linked
    from loomfield.operators.linkage import capped_pairs

    e = table(spark, sf, "events").select("user_id", F.concat_ws(" ", F.to_date("ts").cast("string"), F.get_json_object("props", "$.k")).alias("met"))
    pairs = capped_pairs(e, "met", "user_id", 15).select("a", "b", (F.col("n") / 8).alias("sim"))
    forced = e.where("user_id % 50 = 1").select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b")).distinct()
    return linked(pairs, 0.25, forced)


@query("x49_twins")
def twins(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    e = table(spark, sf, "embeddings").join(d, "vec_id").select("vec_id", "embedding", "text")
    return cluster.twins(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", "text", 5, 0.0).where("ratio >= 0.9")


@query("x24_apply_claims", "WITH h AS (SELECT o_orderpriority AS branch, min(o_custkey) AS holder FROM orders GROUP BY branch) SELECT DISTINCT o_custkey AS thread, branch, holder <> o_custkey AS contributed FROM orders JOIN h ON branch = o_orderpriority")
def apply_claims(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("thread"), F.col("o_orderpriority").alias("branch"))
    return work.apply_claims(o.distinct(), o.groupBy("branch").agg(F.min("thread").alias("holder"))).select("thread", "branch", "contributed")


@query("x17_related", """WITH s AS (SELECT DISTINCT o_custkey AS card, l_partkey AS sink FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'), f AS (SELECT DISTINCT o_custkey AS card, l_partkey AS sink FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
    p AS (SELECT a.card AS a, b.card AS b, 'sink' AS reason, 0 AS p, count(*) AS n FROM s a JOIN s b USING (sink) WHERE a.card <> b.card GROUP BY ALL UNION ALL SELECT a.card, b.card, 'files', 1, count(*) FROM f a JOIN f b USING (sink) WHERE a.card <> b.card GROUP BY ALL),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY p) AS r FROM p) WHERE r = 1) SELECT a, b, reason FROM (SELECT a, b, reason, row_number() OVER (PARTITION BY a ORDER BY p, n DESC, b) AS r FROM m) WHERE r <= 5""")
def related(spark, sf):
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    rows = o.join(line, o.o_orderkey == line.l_orderkey).select(F.col("o_custkey").alias("card"), F.col("l_partkey").alias("sink"), "l_returnflag")
    return work.related(rows.where("l_returnflag = 'R'").select("card", "sink"), rows.where("l_returnflag = 'A'").select("card", F.col("sink").alias("file")))


@query("r13_project_groups", "SELECT o_orderkey AS item, CASE WHEN o_orderstatus = 'O' THEN 'parent:' || o_custkey WHEN o_orderpriority = '1-URGENT' THEN 'component:' || o_orderpriority ELSE 'item:' || o_orderkey END AS project FROM orders")
def project_groups(spark, sf):
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "O", F.col("o_custkey")).alias("parent"), none.alias("linear"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).alias("component"), none.alias("milestone"))
    return work.project_groups(rows)


@query("x29_my_messages", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user' AND length(trim(text, ' ')) >= 20) WHERE r <= 3")
def my_messages(spark, sf):
    return work.my_messages(table(spark, sf, "conversations"))


@query("x29_last_reply", "WITH q AS (SELECT conv_id, max(turn) AS asked FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, arg_min(text, turn) AS reply FROM conversations JOIN q USING (conv_id) WHERE role = 'assistant' AND turn > asked GROUP BY conv_id")
def last_reply(spark, sf):
    return work.last_reply(table(spark, sf, "conversations")).select("conv_id", "reply")


@query("x21_attention", "WITH c AS (SELECT o_custkey, max(o_orderdate) AS made, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, made >= TIMESTAMP '2001-07-01' - INTERVAL 24 HOUR AS active, array_to_string(list_filter([CASE WHEN made >= TIMESTAMP '2001-07-01' - INTERVAL 24 HOUR THEN 'active' END, CASE WHEN n = 1 THEN 'one left' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c")
def attention(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"), F.count_if(F.col("o_orderstatus") != "F").alias("n_open")).withColumn("state", F.lit("open"))
    return work.attention(rows, _now()).select("o_custkey", "active", F.array_join("reasons", ",").alias("reasons"))


@query("x32_ego", """WITH p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*)::DOUBLE AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)
    SELECT CASE WHEN a = 1 THEN b ELSE a END AS person, weight FROM p WHERE a = 1 OR b = 1 ORDER BY weight DESC, person LIMIT 20""")
def ego(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = line.withColumnRenamed("l_suppkey", "a").join(line.withColumnRenamed("l_suppkey", "b"), "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    return people.ego(pairs, 1)


@query("x34_edge_kinds", """SELECT l_suppkey AS a, l_partkey AS b, max(CASE WHEN l_returnflag = 'A' THEN n END) AS na, max(CASE WHEN l_returnflag = 'R' THEN n END) AS nr FROM (SELECT l_suppkey, l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY a, b""")
def edge_kinds(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.count("*").alias("n"))
    kinds = n.groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    return kinds.select("a", "b", F.try_element_at("m", F.lit("A")).alias("na"), F.try_element_at("m", F.lit("R")).alias("nr"))


@query("x36_merge_records", "WITH k AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, url FROM pages) SELECT min(page_id) AS id, host FROM k GROUP BY host")
def merge_records(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.parse_url("url", F.lit("HOST")).alias("host"), F.col("url").alias("name"))
    return people.merge_records(rows, ["host"], "name").select("id", "host")


@query("x12_mine", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AS mine FROM orders")
def mine(spark, sf):
    ids = table(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey", F.lit(True).alias("hit"))
    o = table(spark, sf, "orders")
    return o.join(ids, o.o_custkey == ids.c_custkey, "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("mine"))


@query("x45_centroids_of_corpora", "SELECT lang, i::BIGINT AS pos, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings JOIN documents ON doc_id = vec_id, range(1, 65) t(i) GROUP BY ALL")
def corpora_centroids(spark, sf):
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents").select("doc_id", "lang")
    parts = e.join(d, e.vec_id == d.doc_id).select("lang", F.posexplode("embedding").alias("pos", "x"))
    return parts.groupBy("lang", (F.col("pos") + 1).cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


@query("p18_test_paths", f"WITH {CORPUS_SQL} SELECT doc_id, lang = 'fr' AS test FROM corpus")
def test_paths(spark, sf):
    path = F.concat(F.when(F.col("lang") == "fr", "src/tests/").otherwise("src/attest/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, sf, "documents").select("doc_id", tx.is_test_path(path).alias("test"))


@query("w16_next_state", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS due FROM orders WHERE o_orderstatus = 'O'")
def next_state(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("due"))


@query("w13_multi_key_sort", "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) ORDER BY n DESC, source, lang NULLS LAST LIMIT 40")
def multi_key(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "source", F.col("lang").asc_nulls_last()).limit(40)


@query("w10_carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations")
def carry(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("asked"))
