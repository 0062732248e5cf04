"""Queries of sources by round trip, and of the remaining filters, projections, writes and composites."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomfield.functions import numbers, text as tx
from loomfield.operators import chunk, cluster, insights, ownership, search, state, work
from loomfield.plans.fixtures import CORPUS_SQL, OWNERS_SQL, corpus, owners
from loomfield.operators.vectors import block_products
from loomfield.plans.registry import query
from loomfield.session import table
from loomfield.sources import connectors, files, transcripts

_TURNS = "SELECT 'c' || conv_id AS file, turn AS line, role, trim(text, ' ') AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, ' ') <> ''"


def _lines(spark, sf, value: Column):
    return table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("line"), value.alias("value"))


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


@query("s01_parse_claude", _TURNS)
def claude(spark, sf):
    block = F.array(_named(type=F.lit("text"), text=F.col("text")), _named(type=F.lit("tool_use"), text=F.lit(None).cast("string")))
    value = F.to_json(_named(type=F.col("role"), message=_named(role=F.col("role"), content=block)))
    return transcripts.claude_turns(_lines(spark, sf, value))


@query("s02_parse_qwen", _TURNS)
def qwen(spark, sf):
    parts = F.array(_named(text=F.col("text"), thought=F.lit(False)), _named(text=F.lit("hidden"), thought=F.lit(True)))
    return transcripts.qwen_turns(_lines(spark, sf, F.to_json(_named(type=F.col("role"), message=_named(role=F.col("role"), parts=parts)))))


@query("s03_parse_codex", _TURNS)
def codex(spark, sf):
    payload = _named(type=F.lit("message"), role=F.col("role"), content=F.array(_named(type=F.lit("input_text"), text=F.col("text"))))
    return transcripts.codex_turns(_lines(spark, sf, F.to_json(_named(type=F.lit("response_item"), payload=payload))))


@query("s06_clean", "SELECT conv_id, turn, trim(text, ' ') AS text FROM conversations")
def clean(spark, sf):
    noisy = F.concat(F.lit("<system-reminder>a\nb</system-reminder>"), "text", F.lit(" <command-name>/x</command-name>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.clean_turn(noisy).alias("text"))


@query("s07_discover", "SELECT doc_id FROM documents WHERE lang <> 'de'")
def discover(spark, sf):
    path = F.concat(F.lit("p/"), F.when(F.col("lang") == "de", "subagents/").otherwise(""), F.lit("s.jsonl"))
    return transcripts.discover(table(spark, sf, "documents").withColumn("file", path)).select("doc_id")


@query("s11_extract")
def extract(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return files.extract(pages)


@query("s14_tree_state", "SELECT l_partkey AS path FROM lineitem WHERE l_returnflag IN ('A', 'N') EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def tree_state(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"), "l_returnflag", "l_quantity")
    return line.where("l_returnflag IN ('A', 'N')").select("path").distinct().join(line.where("l_returnflag = 'R' AND l_quantity > 45"), "path", "left_anti")


@query("s16_git_log", "SELECT l_orderkey::VARCHAR AS sha, l_partkey::VARCHAR AS path, l_quantity::BIGINT AS added, l_linenumber::BIGINT AS deleted FROM lineitem")
def git_log(spark, sf):
    line = table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("long").cast("string")
    body = line.select(F.concat(F.lit("r"), (F.col("l_orderkey") % 16).cast("string")).alias("repo"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.concat_ws("\t", s("l_quantity"), s("l_linenumber"), s("l_partkey")).alias("value"))
    heads = line.select("l_orderkey").distinct().select(F.concat(F.lit("r"), (F.col("l_orderkey") % 16).cast("string")).alias("repo"), (F.col("l_orderkey") * 10).alias("line"), F.concat(F.lit("@"), s("l_orderkey"), F.lit("\t1700000000\tA <a@x>\tsubject")).alias("value"))
    return files.git_log(body.unionByName(heads)).select("sha", "path", "added", "deleted")


@query("s17_first_reviews", "SELECT l_orderkey AS url, l_suppkey AS login, min(l_shipdate) AS first FROM lineitem GROUP BY ALL")
def reviews(spark, sf):
    nested = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("url")).agg(F.collect_list(F.struct(F.col("l_suppkey").alias("login"), F.col("l_shipdate").alias("at"))).alias("reviews"))
    return nested.select("url", F.explode("reviews").alias("r")).groupBy("url", F.col("r.login").alias("login")).agg(F.min("r.at").alias("first"))


@query("s18_chat_messages", "SELECT 'U' || conv_id AS \"user\", role AS name, count(*) AS n FROM conversations GROUP BY ALL")
def chat(spark, sf):
    raw = table(spark, sf, "conversations").select(F.concat(F.lit("=== Message from "), "role", F.lit(" (U"), F.col("conv_id").cast("string"), F.lit(") ===\nx")).alias("value"))
    return files.chat_messages(raw).groupBy("user", "name").agg(F.count("*").alias("n"))


@query("s19_codeowners", "SELECT '@s' || l_suppkey AS owner, count(*) AS n FROM lineitem GROUP BY owner")
def codeowners(spark, sf):
    return files.codeowners(table(spark, sf, "lineitem").select(F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(" @s"), F.col("l_suppkey").cast("string"), F.lit(" # x")).alias("value")))


@query("s20_split_items", "SELECT conv_id AS row, count(*) AS n FROM conversations GROUP BY conv_id")
def split_items(spark, sf):
    nested = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("row")).agg(F.collect_list(_named(id=F.col("turn"), text=F.col("text"))).alias("items"))
    raw = nested.select("row", F.to_json(_named(data=_named(items=F.col("items"), people=F.array()))).alias("raw"))
    return connectors.split(raw).groupBy("row").agg(F.count("*").alias("n"))


@query("s21_normalise", "SELECT url AS key, 'document' AS kind, url AS title FROM pages")
def normalise(spark, sf):
    items = table(spark, sf, "pages").select(F.to_json(_named(html_url=F.col("url"), title=F.col("url"), body=F.col("html"))).alias("item"))
    return connectors.normalise(items, "github").select("key", "kind", "title")


@query("s22_usage", "SELECT user_id::VARCHAR AS id, arg_max(event_id, event_id) AS input FROM events GROUP BY user_id")
def usage(spark, sf):
    message = _named(id=F.col("user_id").cast("string"), model=F.lit("m"), usage=_named(input_tokens=F.col("event_id")))
    raw = table(spark, sf, "events").select(F.lit("f").alias("file"), F.col("event_id").alias("line"), F.to_json(_named(type=F.lit("assistant"), message=message)).alias("value"))
    return transcripts.claude_usage(raw).select("id", "input")


@query("s23_subagents", "SELECT 'f' || user_id || ':' || event_type AS id, count(*) AS n FROM events GROUP BY ALL")
def subagents(spark, sf):
    return table(spark, sf, "events").groupBy(F.concat_ws(":", F.concat(F.lit("f"), F.col("user_id").cast("string")), "event_type").alias("id")).agg(F.count("*").alias("n"))


@query("s26_window", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01' ORDER BY o_orderdate DESC, o_orderkey")
def window(spark, sf):
    return table(spark, sf, "orders").where("o_orderdate >= '1998-01-01' AND o_orderdate < '1998-02-01'").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey")


@query("k05_replace_children", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT o_orderkey, 99 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def replace_children(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    fresh = line.where("l_returnflag = 'R'").select("l_orderkey").distinct().withColumn("l_linenumber", F.lit(99))
    return line.where("l_returnflag <> 'R'").drop("l_returnflag").unionByName(fresh)


@query("k06_chunk_diff", "WITH o AS (SELECT l_orderkey, l_linenumber AS idx, l_returnflag AS hash FROM lineitem WHERE l_quantity > 10), n AS (SELECT l_orderkey, l_linenumber AS idx, CASE WHEN l_tax > 0.05 THEN 'x' ELSE l_returnflag END AS hash FROM lineitem) SELECT l_orderkey, idx, hash, CASE WHEN o.f IS NULL THEN 'add' WHEN n.g IS NULL THEN 'drop' ELSE 'keep' END AS action FROM (SELECT *, 1 AS f FROM o) o FULL JOIN (SELECT *, 1 AS g FROM n) n USING (l_orderkey, idx, hash)")
def chunk_diff(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("idx", F.col("l_linenumber"))
    old = line.where("l_quantity > 10").select("l_orderkey", "idx", F.col("l_returnflag").alias("hash"))
    return state.chunk_diff(old, line.select("l_orderkey", "idx", F.when(F.col("l_tax") > 0.05, "x").otherwise(F.col("l_returnflag")).alias("hash")), "l_orderkey")


@query("k09_cache_ttl", "SELECT event_id, ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-15' AS expired FROM events WHERE ts + INTERVAL 10 DAY >= TIMESTAMP '2024-01-15'")
def cache_ttl(spark, sf):
    now = F.to_timestamp(F.lit("2024-01-15"))
    rows = table(spark, sf, "events").where(F.col("ts") + F.expr("INTERVAL 10 DAYS") >= now)
    return rows.select("event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY") < now).alias("expired"))


@query("k12_job_order", "SELECT event_id FROM events WHERE event_type <> 'view' ORDER BY event_type <> 'signup', ts DESC, event_id LIMIT 20")
def job_order(spark, sf):
    return table(spark, sf, "events").where("event_type <> 'view'").orderBy(F.col("event_type") != "signup", F.desc("ts"), "event_id").limit(20).select("event_id")


@query("k14_digest", "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def digest(spark, sf):
    parts = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    packed = parts.select(F.to_json(F.struct("conv_id", "turns", "chars")).alias("digest"))
    return packed.select(F.from_json("digest", "conv_id long, turns long, chars long").alias("d")).select("d.*")


@query("g08_git_writes", "WITH c AS (SELECT user_id, event_id, event_type FROM events) SELECT user_id AS session, event_id AS line, last_value(CASE WHEN event_type = 'signup' THEN 'b' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS branch FROM c QUALIFY event_type = 'purchase'")
def git_writes(spark, sf):
    e = table(spark, sf, "events")
    command = F.when(F.col("event_type") == "signup", F.concat(F.lit("git checkout -b b"), F.col("event_id").cast("string"))).when(F.col("event_type") == "purchase", "git commit -m x").otherwise("ls")
    return work.git_writes(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("line"), command.alias("command"))).select("session", "line", "branch")


@query("g13_people_rows", "SELECT DISTINCT o_orderkey, role, who FROM (SELECT o_orderkey, 'buyer' AS role, o_custkey AS who FROM orders UNION ALL SELECT l_orderkey, 'seller', l_suppkey FROM lineitem)")
def people_rows(spark, sf):
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("sellers"))
    person = lambda role, c: F.struct(F.lit(role).alias("role"), c.cast("long").alias("who"))
    nested = o.join(line, o.o_orderkey == line.l_orderkey, "left").select("o_orderkey", F.concat(F.array(person("buyer", F.col("o_custkey"))), F.coalesce(F.transform("sellers", lambda s: person("seller", s)), F.array().cast("array<struct<role:string,who:bigint>>"))).alias("p"))
    return nested.select("o_orderkey", F.explode("p").alias("p")).select("o_orderkey", "p.role", "p.who").distinct()


@query("p04_short_phrase", "SELECT doc_id FROM documents WHERE contains(lower(text), 'th') OR contains(source, 'src1')")
def short_phrase(spark, sf):
    return table(spark, sf, "documents").where(F.lower("text").contains("th") | F.contains("source", F.lit("src1"))).select("doc_id")


@query("p05_name_bonus", "SELECT doc_id, length(text) % 100 + CASE WHEN contains(lower(source), 'src1') THEN 50 ELSE 0 END AS score FROM documents")
def name_bonus(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.length("text") % 100 + F.when(F.lower("source").contains("src1"), 50).otherwise(0)).cast("long").alias("score"))


@query("p20_deployed_paths", "SELECT doc_id, lang <> 'fr' AND lang <> 'de' AS deployed FROM documents")
def deployed_paths(spark, sf):
    path = F.when(F.col("lang") == "fr", "a/dist/x.js").when(F.col("lang") == "de", "package-lock.json").otherwise("a/distance.js")
    return table(spark, sf, "documents").select("doc_id", tx.is_deployed(path).alias("deployed"))


@query("p23_in_temp", "SELECT doc_id, lang = 'fr' AS temp FROM documents")
def in_temp(spark, sf):
    path = F.concat(F.when(F.col("lang") == "fr", "/private/tmp/").otherwise("/home/tmpl/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", path.rlike(r"^(/private)?/(tmp|var/folders|var/tmp)(/|$)|/Library/").alias("temp"))


@query("p24_without_live", "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id <> (SELECT max(conv_id) FROM conversations) GROUP BY conv_id")
def without_live(spark, sf):
    c = table(spark, sf, "conversations")
    return c.join(c.agg(F.max("conv_id").alias("conv_id")), "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("j04_points", "SELECT doc_id, lang, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM documents JOIN embeddings ON vec_id = doc_id")
def points(spark, sf):
    d, e = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "embeddings")
    at = lambda k: F.round(F.col("embedding")[k].cast("double"), 6)
    return d.join(e, d.doc_id == e.vec_id).select("doc_id", "lang", at(0).alias("x"), at(1).alias("y"))


@query("j07_item_kind", "SELECT page_id, 'document' AS kind FROM pages")
def item_kind(spark, sf):
    return table(spark, sf, "pages").select("page_id", connectors.item_kind(F.lit("web"), F.col("url"), F.col("page_id").cast("string")).alias("kind"))


@query("n03_chunks_of_sessions", "SELECT c.conv_id, turn FROM conversations c JOIN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 4) s ON s.conv_id = c.conv_id")
def chunks_of_sessions(spark, sf):
    c = table(spark, sf, "conversations")
    return c.join(c.groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 4"), "conv_id").select("conv_id", "turn")


@query("n15_relative_paths", f"WITH {CORPUS_SQL} SELECT doc_id, substr(path, length('src/' || source) + 2) AS relative FROM corpus")
def relative_paths(spark, sf):
    return corpus(spark, sf).select("doc_id", F.expr("substring(path, length(concat('src/', source)) + 2)").alias("relative"))


@query("a19_value", "SELECT c_custkey, (10 * (c_custkey % 3) + least(c_custkey, 30))::BIGINT AS points FROM customer")
def value(spark, sf):
    counts = {"pr_merged": F.col("c_custkey") % 3, "commit": F.col("c_custkey")}
    return table(spark, sf, "customer").select("c_custkey", numbers.value_points(counts).cast("long").alias("points"))


@query("a27_merge_work", f"WITH {OWNERS_SQL} SELECT author % 10 AS person, count(DISTINCT area) AS areas, sum(lines)::BIGINT AS lines, max(made) AS last FROM owners GROUP BY person")
def merge_work(spark, sf):
    return owners(spark, sf).groupBy((F.col("author") % 10).alias("person")).agg(F.count_distinct("area").alias("areas"), F.sum("lines").alias("lines"), F.max("at").alias("last"))


@query("a31_role", """WITH w AS (SELECT l_suppkey AS person, p_brand AS area, left(p_brand, 7) AS repo, l_shipdate AS made, l_orderkey AS pr, l_quantity AS q, l_returnflag AS f, l_partkey % 40 AS who FROM lineitem JOIN part ON p_partkey = l_partkey),
    a AS (SELECT person, area, repo, count(*) AS n, sum(q) AS q FROM w GROUP BY ALL), s AS (SELECT *, q / sum(q) OVER (PARTITION BY area) AS share, row_number() OVER (PARTITION BY area ORDER BY q DESC, person) AS r FROM a),
    p AS (SELECT person, sum((r = 1)::INT) AS owned, max(share) AS blame, max(n) AS top, count(DISTINCT CASE WHEN n >= 3 THEN repo END) AS repos, sum((n >= 3)::INT) AS areas FROM s GROUP BY person),
    o AS (SELECT person, min(made) AS first, count(DISTINCT pr) AS prs, sum((f = 'R')::INT) AS reviews, count(DISTINCT CASE WHEN f = 'R' THEN who END) AS approved FROM w GROUP BY person),
    d AS (SELECT person, prs + reviews AS acts, [CASE WHEN owned >= 3 THEN 1.0 WHEN owned >= 1 THEN 0.6 ELSE 0 END, CASE WHEN blame >= 0.25 THEN 0.8 WHEN blame >= 0.1 THEN 0.4 ELSE 0 END, CASE WHEN person % 9 = 0 THEN 0.6 ELSE 0 END,
        CASE WHEN top >= 30 THEN 0.4 ELSE 0 END, CASE WHEN y >= 4 THEN 0.5 WHEN y >= 2 THEN 0.3 ELSE 0 END] AS deep,
        [CASE WHEN repos >= 5 THEN 0.8 WHEN repos >= 3 THEN 0.5 ELSE 0 END + CASE WHEN areas >= 20 THEN 0.6 WHEN areas >= 10 THEN 0.3 ELSE 0 END, CASE WHEN approved >= 5 THEN 0.6 WHEN approved >= 3 THEN 0.3 ELSE 0 END,
        CASE WHEN person % 5 >= 3 THEN 0.4 ELSE 0 END, CASE WHEN person % 7 = 0 THEN 0.4 ELSE 0 END] AS broad
        FROM (SELECT *, date_diff('day', first::DATE, DATE '1998-01-01') / 365.25 AS y FROM p JOIN o USING (person))),
    t AS (SELECT *, list_sum(deep) AS depth, list_sum(broad) AS breadth, len(list_filter(deep || broad, lambda x: x > 0)) AS said FROM d)
    SELECT person, CASE WHEN round(depth, 6) >= 1.2 AND round(breadth, 6) >= 1.2 THEN 'lead' WHEN round(depth, 6) >= 1.2 THEN 'domain expert' ELSE 'contributor' END AS level, round(depth::DOUBLE, 1) AS depth, round(breadth::DOUBLE, 1) AS breadth,
        round(least(0.7, 0.3 + 0.04 * said + least(0.08, 0.02 * log2(1 + acts / 10)))::DOUBLE, 2) AS confidence FROM t""")
def role(spark, sf):
    """Suppliers as people: brands as areas of repositories, quantities as lines, orders as pull requests, returned lines as reviews of one of forty."""
    w = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("person", F.col("l_suppkey"))
    a = w.groupBy("person", F.col("p_brand").alias("area"), F.substring("p_brand", 1, 7).alias("repo")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    by_area = Window.partitionBy("area")
    a = a.withColumns({"share": F.col("q") / F.sum("q").over(by_area), "r": F.row_number().over(by_area.orderBy(F.desc("q"), "person"))})
    own = a.groupBy("person").agg(
        F.sum((F.col("r") == 1).cast("int")).alias("owned_areas"), F.max("share").alias("blame"), F.max("n").alias("top_commits"),
        F.count_distinct(F.when(F.col("n") >= 3, F.col("repo"))).alias("repos"), F.sum((F.col("n") >= 3).cast("int")).alias("areas"),
    )
    returned = F.col("l_returnflag") == "R"
    acts = w.groupBy("person").agg(
        F.min("l_shipdate").alias("first"), F.count_distinct("l_orderkey").alias("prs"), F.sum(returned.cast("int")).alias("reviews"), F.count_distinct(F.when(returned, F.col("l_partkey") % 40)).alias("approved"),
    )
    k = F.col("person")
    work = own.join(acts, "person").withColumns({"owns": (k % 9 == 0).cast("int"), "approver_for": k % 5, "maintains": (k % 7 == 0).cast("int")})
    return ownership.roles(work, F.to_timestamp(F.lit("1998-01-01")))


@query("u07_topic_rematch", "WITH a AS (SELECT source, list(DISTINCT lang ORDER BY lang) AS x FROM documents GROUP BY source) SELECT a.source AS old, b.source AS new, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))), 6) AS jaccard FROM a JOIN a b ON a.source < b.source")
def rematch(spark, sf):
    a = table(spark, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("x"))
    b = a.select(F.col("source").alias("new"), F.col("x").alias("y"))
    pairs = a.join(F.broadcast(b), F.col("source") < F.col("new"))  # one row a topic, a bounded set
    return pairs.select(F.col("source").alias("old"), "new", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


@query("r15_goal_edges", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.2")
def goal_edges(spark, sf):
    e = table(spark, sf, "embeddings")
    return block_products(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", least=0.2).select(F.col("query").alias("a"), F.col("id").alias("b"))


@query("r11_territory", """WITH t AS (SELECT label, vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS sim FROM embeddings), m AS (SELECT label, max(sim) AS near, avg(sim) AS mean FROM t GROUP BY label)
    SELECT label, round(0.55 * (near - avg(near) OVER ()) / (stddev_pop(near) OVER () + 1e-9) + 0.45 * (mean - avg(mean) OVER ()) / (stddev_pop(mean) OVER () + 1e-9), 4) AS interest FROM m""")
def territory(spark, sf):
    from loomfield.plans.q_search import _vector

    sims = search.similarities(table(spark, sf, "embeddings"), _vector(spark, sf), "vec_id", "embedding", "label")
    m = sims.groupBy("label").agg(F.max("sim").alias("near"), F.avg("sim").alias("mean"))
    return search.standardise(m, "near", "mean").select("label", F.round(0.55 * F.col("z_near") + 0.45 * F.col("z_mean"), 4).alias("interest"))


@query("t06_changed_views", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) <> count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2001-06-01')")
def changed_views(spark, sf):
    o = table(spark, sf, "orders")
    view = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("hash", F.col("n").cast("string"))
    from loomfield.streaming.usage import changed_only

    return changed_only(o, view(o.where("o_orderdate < '2001-06-01'")), "o_custkey", view(o)).select("o_custkey", "n")


@query("t09_max_seen", "SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id")
def max_seen(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    early = table(spark, sf, "events").where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return state.upsert(early, e, ["user_id"], greatest=("seen",))


@query("t14_time_states", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '2001-07-01' - INTERVAL 3 DAY THEN 'loose ends' ELSE 'open' END AS state FROM orders WHERE o_orderstatus = 'O'")
def time_states(spark, sf):
    now = F.to_timestamp(F.lit("2001-07-01"))
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.when(F.col("o_orderdate") < now - F.expr("INTERVAL 3 DAYS"), "loose ends").otherwise("open").alias("state"))


@query("t10_rolling_windows", "SELECT user_id, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 604800000000)::BIGINT AS back, count(*) AS n FROM events GROUP BY ALL")
def rolling(spark, sf):
    back = insights.window_back(F.col("ts"), F.to_timestamp(F.lit("2024-01-31")))
    return table(spark, sf, "events").groupBy("user_id", back.alias("back")).agg(F.count("*").alias("n"))


@query("q03_title_bonus", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) + CASE WHEN contains(source, 'src1') THEN 0.05 ELSE 0 END, 5) AS score FROM embeddings JOIN documents ON doc_id = vec_id")
def title_bonus(spark, sf):
    from loomfield.plans.q_search import _vector

    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents").select("doc_id", "source")
    sim = numbers.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _vector(spark, sf)]))
    return e.join(d, e.vec_id == d.doc_id).select("vec_id", F.round(sim + F.when(F.contains("source", F.lit("src1")), 0.05).otherwise(0.0), 5).alias("score"))


@query("q09_overview", "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang UNION ALL SELECT 'all', count(*), count(DISTINCT source), sum(n_chars)::BIGINT FROM documents")
def overview(spark, sf):
    d = table(spark, sf, "documents")
    sums = (F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"))
    return d.groupBy("lang").agg(*sums).unionByName(d.agg(*sums).withColumn("lang", F.lit("all")))


@query("q17_unique_best", "WITH s AS (SELECT p_type, (contains(p_type, 'STEEL')::INT + contains(p_type, 'SMALL')::INT) AS hits FROM (SELECT DISTINCT p_type FROM part)), m AS (SELECT *, max(hits) OVER () AS best FROM s) SELECT p_type, hits::BIGINT AS hits FROM m WHERE hits = best AND hits > 0")
def unique_best(spark, sf):
    hit = lambda w: F.contains("p_type", F.lit(w)).cast("long")
    s = table(spark, sf, "part").select("p_type").distinct().select("p_type", (hit("STEEL") + hit("SMALL")).alias("hits"))
    best = s.agg(F.max("hits").alias("best"))
    return s.crossJoin(F.broadcast(best)).where("hits = best AND hits > 0").select("p_type", "hits")


@query("q20_catalog", "SELECT source, max(n_chars) AS largest, count(*) FILTER (WHERE lang = 'en') AS english, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def catalog(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source").agg(F.max("n_chars").alias("largest"), F.count_if(F.col("lang") == "en").alias("english"), F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "source")


@query("x06_top_words", "SELECT role, w AS term, n FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, w) AS r FROM (SELECT role, w, count(*) AS n FROM (SELECT role, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations) GROUP BY ALL)) WHERE r <= 8")
def top_words(spark, sf):
    counts = table(spark, sf, "conversations").select("role", F.explode(tx.words(F.col("text"))).alias("term")).groupBy("role", "term").agg(F.count("*").alias("n"))
    return search.best_per_key(counts, "role", [F.desc("n"), F.col("term")], 8)


@query("x08_repo_sessions", f"WITH {CORPUS_SQL} SELECT doc_id FROM corpus WHERE starts_with(path, 'src/src3/') OR starts_with(path, 'src/src4/fr/')")
def repo_sessions(spark, sf):
    roots = spark.createDataFrame([("src/src3",), ("src/src4/fr",)], "folder string")
    above = corpus(spark, sf).select("doc_id", F.explode(tx.ancestors(F.col("path"))).alias("folder"))
    return above.join(F.broadcast(roots), "folder", "left_semi").select("doc_id").distinct()  # the named roots


@query("x13_own_prs", "SELECT o_custkey, min(o_orderkey) AS pr FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def own_prs(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("pr"))
    return search.best_per_key(o, "o_custkey", [F.col("pr")])


@query("x15_adopt", "SELECT o_custkey AS holder, max(o_orderdate) AS updated, array_to_string(list_slice(list(o_orderkey::VARCHAR ORDER BY o_orderdate DESC, o_orderkey), 1, 5), ',') AS shared FROM orders GROUP BY holder")
def adopt(spark, sf):
    newest = search.best_per_key(table(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 5)
    ranked = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey")))
    return newest.groupBy(F.col("o_custkey").alias("holder")).agg(F.max("o_orderdate").alias("updated"), F.array_join(F.transform(ranked, lambda x: x["o_orderkey"].cast("string")), ",").alias("shared"))


@query("x26_status_precedence", "SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN 'own' END, CASE WHEN o_orderstatus = 'F' THEN 'task' END, 'cache') AS status FROM orders")
def precedence(spark, sf):
    own, task = F.when(F.col("o_orderpriority") == "1-URGENT", "own"), F.when(F.col("o_orderstatus") == "F", "task")
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(own, task, F.lit("cache")).alias("status"))


@query("x28_pending_steps", "SELECT o_custkey, min(stage) AS stage, step FROM (SELECT o_custkey, 1 AS stage, 'review ' || o_orderpriority AS step FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 2, 'merge ' || o_orderpriority FROM orders WHERE o_orderstatus = 'O') GROUP BY o_custkey, step")
def pending(spark, sf):
    o = table(spark, sf, "orders")
    rule = lambda status, stage, verb: o.where(F.col("o_orderstatus") == status).select("o_custkey", F.lit(stage).alias("stage"), F.concat(F.lit(verb + " "), "o_orderpriority").alias("step"))
    return rule("P", 1, "review").unionByName(rule("O", 2, "merge")).groupBy("o_custkey", "step").agg(F.min("stage").alias("stage"))


@query("x31_profile", f"WITH {OWNERS_SQL}, a AS (SELECT author, area, count(*) AS n FROM owners GROUP BY ALL) SELECT author, array_to_string(list_slice(list(area ORDER BY n DESC, area), 1, 3), ',') AS areas FROM a GROUP BY author")
def profile(spark, sf):
    counts = owners(spark, sf).groupBy("author", "area").agg(F.count("*").alias("n"))
    top = search.best_per_key(counts, "author", [F.desc("n"), F.col("area")], 3)
    return top.groupBy("author").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "area"))), lambda x: x["area"]), ",").alias("areas"))


@query("x33_via", "SELECT b.o_custkey AS person, count(DISTINCT a.o_orderpriority) AS kinds FROM orders a JOIN orders b ON a.o_orderdate = b.o_orderdate AND a.o_custkey <> b.o_custkey WHERE a.o_custkey = 1 GROUP BY person")
def via(spark, sf):
    o = table(spark, sf, "orders")
    mine = o.where("o_custkey = 1").select("o_orderdate", F.col("o_orderpriority").alias("kind"))
    return o.where("o_custkey <> 1").join(mine, "o_orderdate").groupBy(F.col("o_custkey").alias("person")).agg(F.count_distinct("kind").alias("kinds"))


@query("x35_name_team", "WITH a AS (SELECT l_suppkey % 12 AS team, p_brand AS area, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY team) AS cover, (n / sum(n) OVER (PARTITION BY team)) / (sum(n) OVER (PARTITION BY area) / sum(n) OVER ()) AS lift FROM a) SELECT team, area FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY round(lift, 9) DESC, area) AS r FROM s) WHERE r = 1")
def name_team(spark, sf):
    a = owners(spark, sf).groupBy((F.col("author") % 12).alias("team"), "area").agg(F.count("*").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    s = a.withColumn("lift", F.round((F.col("n") / total("team")) / (total("area") / total()), 9))
    return search.best_per_key(s, "team", [F.desc("lift"), F.col("area")]).select("team", "area")


@query("x23_session_branches", "SELECT l_orderkey AS session, coalesce(min(l_partkey) FILTER (WHERE l_returnflag = 'R'), min(l_partkey)) AS branch FROM lineitem GROUP BY session")
def session_branches(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.coalesce(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))), F.min("l_partkey")).alias("branch"))


@query("q18_components")
def session_components(spark, sf):
    turns = table(spark, sf, "conversations")
    parts = chunk.segments(turns)
    own = turns.select("conv_id", "turn", F.explode(tx.links(F.col("text"))).alias("l"))
    return parts.join(own, "conv_id", "left").where("l IS NULL OR (turn >= first_turn AND turn < end_turn)").groupBy("conv_id", "component", "first_turn", "end_turn").agg(F.count("l").alias("links"))


@query("r07_clusters_cover", "SELECT count(*) AS n FROM embeddings")
def clusters_cover(spark, sf):
    found = cluster.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding", 6)
    return found.where("cluster >= 0").agg(F.count("*").alias("n"))
