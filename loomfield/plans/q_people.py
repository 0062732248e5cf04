"""Queries of people, keywords, clusters and layout."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.operators import cluster, linkage, meetings, org, people
from loomfield.operators import identity as identities
from loomfield.operators import teams as work_teams
from loomfield.operators.rounds import written
from loomfield.plans.registry import query
from loomfield.session import table


def _now() -> Column:
    return F.to_timestamp(F.lit("2024-01-31"))

_ACTS = "acts AS (SELECT a.user_id AS a, b.user_id AS b, a.event_type AS kind, count(*) AS n, max(a.ts) AS last FROM events a JOIN events b ON a.ts::DATE = b.ts::DATE AND hour(a.ts) = hour(b.ts) AND a.event_type = b.event_type AND a.user_id < b.user_id GROUP BY ALL)"
_EDGES = f"{_ACTS}, edges AS (SELECT a, b, sum(CASE kind WHEN 'purchase' THEN 2.0 WHEN 'click' THEN 1.0 ELSE 0 END * ln(1 + n) * pow(0.5, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last)) / 86400000000 / 120)) AS weight FROM acts GROUP BY ALL)"


_WEIGHTS = {"purchase": 2.0, "click": 1.0}


def _acts(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("person"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))


def _edges_of(spark, sf, me):
    """The edges of one person, from its own acts alone."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", F.date_trunc("hour", "ts").alias("h"))
    mine = e.where(F.col("user_id") == me).select(F.lit(me).cast("long").alias("me"), "event_type", "h", F.col("ts").alias("mine"))
    met = e.join(F.broadcast(mine), ["event_type", "h"]).where("user_id <> me")
    first = F.col("user_id") < F.col("me")
    acts = met.groupBy(F.least("user_id", "me").alias("a"), F.greatest("user_id", "me").alias("b"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max(F.when(first, F.col("ts")).otherwise(F.col("mine"))).alias("last"))
    return people.edge_weights(acts, _WEIGHTS, _now())


@query("a25_edge_weights", f"WITH {_EDGES} SELECT a, b, round(weight, 5) AS weight FROM edges")
def edges(spark, sf):
    return meetings.meeting_edges(_acts(spark, sf), _WEIGHTS, _now()).select("a", "b", F.round("weight", 5).alias("weight"))


@query("a26_closeness", f"""WITH {_EDGES}, sides AS (SELECT a, b, weight AS w FROM edges UNION ALL SELECT b, a, weight FROM edges), d AS (SELECT b AS via, w FROM sides WHERE a = 1),
    p AS (SELECT t.b AS person, max(d.w * t.w / (SELECT max(w) FROM d)) AS p FROM d JOIN sides t ON t.a = d.via WHERE t.b <> 1 GROUP BY person),
    r AS (SELECT coalesce(via, person) AS person, coalesce(w, 0) + 0.25 * coalesce(p, 0) AS raw FROM d FULL JOIN p ON person = via)
    SELECT person, round(raw / (SELECT max(raw) FROM r), 6) AS closeness FROM r""")
def closeness(spark, sf):
    direct = written(_edges_of(spark, sf, 1).select(F.when(F.col("a") == 1, F.col("b")).otherwise(F.col("a")).alias("via"), F.col("weight").alias("w")))
    return people.closeness(direct, meetings.best_paths(_acts(spark, sf), direct, 1, _WEIGHTS, _now()))


@query("n21_identity_candidates", """SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON regexp_extract(c.c_name, '([0-9]+)', 1) = regexp_extract(s.s_name, '([0-9]+)', 1)""")
def identity(spark, sf):
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    c, s = table(spark, sf, "customer").select("c_custkey", number("c_name").alias("k")), table(spark, sf, "supplier").select("s_suppkey", number("s_name").alias("k"))
    return c.join(s, "k").select("c_custkey", "s_suppkey")


@query("r03_candidate_scores", "SELECT c_custkey, round(least(0.99, 0.5 + CASE WHEN c_acctbal > 0 THEN 0.08 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 0.04 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 0.08 ELSE 0 END - CASE WHEN c_custkey % 5 = 0 THEN 0.4 ELSE 0 END), 6)::DOUBLE AS score FROM customer")
def scores(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lit(0.5).alias("base"), (F.col("c_acctbal") > 0).alias("same_repo"), (F.col("c_custkey") % 2 == 0).alias("same_month"), (F.col("c_custkey") % 3 == 0).alias("same_task"), (F.col("c_custkey") % 5 == 0).alias("reviewed"))
    return people.candidate_scores(c).select("c_custkey", "score")


@query("r02_resolve")
def resolve(spark, sf):
    """Customers as observations: a work mail or a chat account, a login and a name that a few share; neighbours by account balance as candidates."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.col("c_custkey").cast("string").alias("k"))
    mail = F.concat(F.lit("email:u"), "k", F.when(F.col("c_custkey") % 4 == 0, "@gmail.com").otherwise(F.concat(F.lit("@n"), F.col("c_nationkey").cast("string"), F.lit(".io"))))
    account = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("slack:S"), "k"))
    name = F.concat(F.lit("name:p"), F.pmod(F.xxhash64("c_custkey"), F.lit(80)).cast("string"), F.lit(" n"), F.col("c_nationkey").cast("string"))
    seen = c.select(F.col("c_custkey").alias("obs"), F.array_compact(F.array(mail, account, F.concat(F.lit("gh:h"), "k"), name)).alias("keys"))
    next_one = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    near = c.select("k", F.lead("k").over(next_one).alias("other")).where("other IS NOT NULL")
    score = F.lit(0.5) + F.pmod(F.xxhash64("k", "other"), F.lit(50)) / 100
    candidates = near.select(F.concat(F.lit("gh:h"), "k").alias("a"), F.concat(F.lit("gh:h"), "other").alias("b"), score.alias("score"))
    some = lambda n, what: c.where(F.col("c_custkey") % n == 0).select(what.alias("key"))
    login = F.concat(F.lit("gh:h"), "k")
    merge = c.where("c_custkey % 50 = 1").select(login.alias("a"), F.concat(F.lit("gh:h"), (F.col("c_custkey") + 1).cast("string")).alias("b"))
    got = identities.resolve(seen, candidates, some(2, mail), some(97, login), merge, some(60, login))
    refused = got.rejected.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("refused"))
    return got.people.join(refused, "key", "left").fillna(0, ["refused"])


def _work(spark, sf):
    """Users' areas, channels and groups from events: two thirds of the events of a user are in areas of its crowd, the rest anywhere."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").alias("member"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    own = F.concat_ws("-", F.lit("a"), (F.col("member") % 12).cast("string"), (F.col("k") % 4).cast("string"))
    anywhere = F.concat(F.lit("s"), (F.col("k") % 50).cast("string"))
    areas = e.groupBy("member", F.when(F.col("event_id") % 3 != 0, own).otherwise(anywhere).alias("key")).agg(F.count("*").alias("n"))
    channel = F.concat_ws("-", F.lit("c"), F.floor(F.col("member") / 20).cast("string"), "event_type")
    channels = e.groupBy("member", channel.alias("key")).agg(F.count("*").alias("n"))
    groups = e.where("member < 60").select("member", (F.col("member") % 9).alias("key")).distinct()
    return areas, channels, groups


@query("r05_teams")
def teams(spark, sf):
    areas, channels, groups = _work(spark, sf)
    members = areas.select("member").distinct().withColumn("place", F.xxhash64("member"))
    return work_teams.teams(members, work_teams.likeness(areas, channels, groups))


@query("q13_org")
def organisation(spark, sf):
    """Users' teams and roles from events: crowds as repositories, purchases as approvals of the next user of the crowd."""
    areas, channels, groups = _work(spark, sf)
    areas = areas.withColumn("repo", F.coalesce(F.get(F.split("key", "-"), F.lit(1)), F.lit("shared")))
    e = table(spark, sf, "events").withColumn("person", F.col("user_id"))
    bought = e.where("event_type = 'purchase'")
    approvals = bought.groupBy(F.col("person").alias("author"), ((F.col("person") + 12 * (F.col("event_id") % 3)) % 48).alias("approver")).agg(F.count("*").alias("n"))
    share = e.groupBy("person").agg(F.count("*").alias("prs"), F.count_if(F.col("event_type") == "click").alias("reviews"), F.min("ts").cast("timestamp").alias("first"))
    facts = share.select("person", (F.col("reviews") / F.col("prs") / 2).alias("blame"), (F.col("person") % 8 == 0).alias("owns"), (F.col("first") - F.expr("make_dt_interval(cast(person % 6 AS int) * 365)")).alias("first"), "prs", "reviews")
    people_ = share.select("person", F.xxhash64("person").alias("place"))
    got = org.infer(people_, areas, channels, groups.withColumn("maintains", F.col("member") % 4 == 0), approvals, facts, _now())
    return got.people.join(got.teams.select("team", "name", "size"), "team", "left")


@query("r06_work_likeness", """WITH e AS (SELECT event_id, event_type, user_id AS m, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
    own AS (SELECT 0 AS part, m, CASE WHEN event_id % 3 <> 0 THEN concat_ws('-', 'a', m % 12, k % 4) ELSE 's' || (k % 50) END AS key, count(*) AS n FROM e GROUP BY ALL
        UNION ALL SELECT 1, m, concat_ws('-', 'c', m // 20, event_type), count(*) FROM e GROUP BY ALL),
    df AS (SELECT part, key, count(*) AS df FROM own GROUP BY ALL), total AS (SELECT count(DISTINCT m) AS t FROM e),
    w AS (SELECT part, m, key, ln(1 + n) * ln(1 + t / df) AS w FROM own JOIN df USING (part, key), total), norm AS (SELECT part, m, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
    dot AS (SELECT x.part, x.m AS a, y.m AS b, sum(x.w * y.w) AS d FROM w x JOIN w y ON x.part = y.part AND x.key = y.key AND x.m < y.m GROUP BY ALL),
    cos AS (SELECT dot.part AS part, a, b, d / (na.norm * nb.norm) AS c FROM dot JOIN norm na ON na.part = dot.part AND na.m = a JOIN norm nb ON nb.part = dot.part AND nb.m = b),
    pairs AS (SELECT a, b FROM cos UNION SELECT x.m, y.m FROM (SELECT DISTINCT m FROM e WHERE m < 60) x, (SELECT DISTINCT m FROM e WHERE m < 60) y WHERE x.m < y.m AND x.m % 9 = y.m % 9)
    SELECT p.a, p.b, round((0.6 * coalesce(c0.c, 0) + 0.25 * coalesce(c1.c, 0) + CASE WHEN p.a < 60 AND p.b < 60 AND p.a % 9 = p.b % 9 THEN 0.15 ELSE 0 END)
        / (0.85 + CASE WHEN p.a < 60 AND p.b < 60 THEN 0.15 ELSE 0 END), 6) AS sim
    FROM pairs p LEFT JOIN cos c0 ON c0.part = 0 AND c0.a = p.a AND c0.b = p.b LEFT JOIN cos c1 ON c1.part = 1 AND c1.a = p.a AND c1.b = p.b""")
def work_likeness(spark, sf):
    return work_teams.work_likeness(*_work(spark, sf), digits=6)


@query("a28_shared_hosts", "SELECT host, n FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY host) WHERE n >= 3")
def stems(spark, sf):
    return table(spark, sf, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n")).where("n >= 3")


@query("p22_mail_class", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'placeholder' WHEN doc_id % 3 = 1 THEN 'personal' ELSE 'work' END AS kind FROM documents")
def mails(spark, sf):
    k = F.col("doc_id") % 3
    mail = F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.when(k == 0, "@localhost").when(k == 1, "@gmail.com").otherwise("@acme.io"))
    return table(spark, sf, "documents").select("doc_id", tx.mail_class(mail).alias("kind"))


@query("a33_keywords", """WITH t AS (SELECT lang, w, count(*) AS tf FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) GROUP BY ALL), d AS (SELECT w, count(*) AS df FROM t GROUP BY w),
    s AS (SELECT lang, w, (1 + ln(tf)) * (ln((1 + 4) / (1 + df)) + 1) AS s FROM t JOIN d USING (w) WHERE df <= 0.6 * 4)
    SELECT lang, w AS term, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(s, 9) DESC, w) AS r FROM s) WHERE r <= 6""")
def keywords(spark, sf):
    return cluster.keywords(table(spark, sf, "documents"), "lang", F.col("text"), 6).select("lang", "term", F.col("rank").cast("long").alias("rank"))


@query("r07_kmeans")
def kmeans(spark, sf):
    return cluster.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding", 6)


@query("r08_layout")
def layout(spark, sf):
    return cluster.layout(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("r09_place_new", """WITH n AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS r FROM n) SELECT id, round(sum(greatest(sim, 0.001) * other) / sum(greatest(sim, 0.001)), 4) AS x FROM k WHERE r <= 5 GROUP BY id""")
def place(spark, sf):
    e = table(spark, sf, "embeddings")
    placed = e.where("vec_id % 100 <> 0").select("vec_id", "embedding", F.col("vec_id").cast("double").alias("x"))
    return cluster.place_new(e.where("vec_id % 100 = 0"), placed, "vec_id", "embedding", ["x"], 5).select(F.col("vec_id").alias("id"), F.round("x", 4).alias("x"))


@query("x46_representatives", """WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label)
    SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(list_inner_product(embedding::DOUBLE[], c), 6) DESC, vec_id) AS r FROM embeddings JOIN c USING (label)) WHERE r <= 24""")
def representatives(spark, sf):
    return cluster.representatives(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 24)


@query("r06_set_similarity", """WITH s AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS k FROM lineitem), n AS (SELECT a, count(*) AS n FROM s GROUP BY a)
    SELECT x.a AS a, y.a AS b, round(count(*) / (max(nx.n) + max(ny.n) - count(*)), 6) AS sim FROM s x JOIN s y ON x.k = y.k AND x.a < y.a JOIN n nx ON nx.a = x.a JOIN n ny ON ny.a = y.a GROUP BY ALL""")
def set_similarity(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("k"))
    return linkage.set_similarity(s).select("a", "b", F.round("sim", 6).alias("sim"))
