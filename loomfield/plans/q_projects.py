"""Queries of the project model: customers as tickets, orders as pull requests, lines as commits and reviews, suppliers as branches, conversations as cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.operators import projects
from loomfield.plans.registry import query
from loomfield.session import table

ME, TICKETS = "p7", 150
NOW_SQL = "TIMESTAMP '2024-01-31'"


def now() -> Column:
    return F.to_timestamp(F.lit("2024-01-31"))


def _ago(days: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(now()) - days * 86400)


def _key(n: Column) -> Column:
    return F.concat(F.lit("CU-"), n.cast("string"))


def _person(n: Column) -> Column:
    return F.concat(F.lit("p"), (n % 97).cast("string"))


def sources(spark, sf) -> dict[str, DataFrame]:
    c, o, s = F.col("c_custkey"), F.col("o_orderkey"), F.col("s_suppkey")
    line = table(spark, sf, "lineitem")
    talks = table(spark, sf, "conversations").select("conv_id").distinct()
    url, card = F.concat(F.lit("pr/"), F.col("l_orderkey")), F.concat(F.lit("c"), F.col("conv_id"))
    title = F.when(c % 3 == 0, F.concat(F.lit("["), "c_mktsegment", F.lit("] ticket "), c)).when(c % 3 == 1, F.concat(F.lit("Area "), c % 400, F.lit(": ticket"))).otherwise(F.concat(F.lit("ticket "), c))
    state = F.when(c % 11 == 0, "done").when(c % 11 == 1, "close").when(c % 11 == 2, "progress").otherwise("todo")
    pr_state = F.when(F.col("o_orderstatus") == "F", "merged").when(o % 5 == 0, "closed").when(o % 5 == 1, "review").when(o % 5 == 2, "draft").otherwise("open")
    body = F.when(o % 16 == 2, F.concat(F.lit("see "), _key(F.col("o_custkey")), F.lit(" and "), _key(F.col("o_custkey") * 7 % TICKETS)))
    return {
        "tickets": table(spark, sf, "customer").select(
            _key(c).alias("key"), title.alias("title"), state.alias("state"), _ago(c % 200).alias("updated"), F.when(c % 10 == 3, _key(F.col("c_nationkey"))).alias("parent"),
            F.when(c % 10 == 4, F.col("c_mktsegment")).alias("linear"), F.when(c % 10 == 5, F.concat(F.lit("n"), "c_nationkey")).alias("component"),
        ),
        "links": table(spark, sf, "customer").where("c_custkey % 9 = 1").select(_key(c).alias("a"), _key(c + 11).alias("b")),
        "assignees": table(spark, sf, "customer").where("c_custkey % 2 = 0").select(_key(c).alias("key"), _person(F.col("c_custkey") * 5).alias("person")),
        "pulls": table(spark, sf, "orders").select(
            F.concat(F.lit("pr/"), o).alias("url"), F.concat(F.lit("repo"), o % 6).alias("repo"), F.when(o % 16 == 0, F.concat(_key(F.col("o_custkey")), F.lit(" work"))).otherwise("work").alias("title"),
            F.when(o % 16 == 1, F.concat(_key(F.col("o_custkey")), F.lit("-fix"))).alias("head"), body.alias("body"), pr_state.alias("state"), _person(o).alias("author"),
            F.when(o % 13 == 0, F.concat(F.lit("v"), o % 3)).alias("milestone"), _ago(o % 150).alias("updated"),
        ),
        "reviewers": line.where("l_linenumber <= 2").select(url.alias("url"), _person(F.col("l_suppkey") * 3).alias("person")),
        "branches": table(spark, sf, "supplier").select(F.concat(F.lit("s@"), s).alias("ref"), F.concat(_key(s * 13 % TICKETS), F.lit("-x")).alias("name"), _person(s).alias("author"), _ago(s % 60).alias("updated")),
        "commits": line.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ref"), _person(F.col("l_partkey")).alias("author"),
            F.when(F.col("l_partkey") % 50 == 0, F.concat(_key(F.col("l_suppkey") * 11 % TICKETS), F.lit(": tidy"))).otherwise("tidy").alias("subject"), _ago(F.col("l_orderkey") % 200).alias("at"),
        ),
        "card_keys": talks.select(card.alias("card"), _key(F.col("conv_id") * 3 % TICKETS).alias("key"), _ago(F.col("conv_id") % 40).alias("updated")),
        "card_pulls": talks.select(card.alias("card"), F.concat(F.lit("pr/"), F.col("conv_id") * 5).alias("url")),
        "closeness": table(spark, sf, "supplier").groupBy(_person(s).alias("person")).agg(F.max((s * 31 % 100) / 100).alias("closeness")),
    }


_AGO = f"{NOW_SQL} - to_days(({{}})::INT)"
_SQL = f"""tk AS (SELECT 'CU-' || c_custkey AS key, CASE c_custkey % 11 WHEN 0 THEN 'done' WHEN 1 THEN 'close' WHEN 2 THEN 'progress' ELSE 'todo' END AS state, {_AGO.format('c_custkey % 200')} AS updated FROM customer),
    pl AS (SELECT 'pr/' || o_orderkey AS url, CASE WHEN o_orderkey % 16 = 0 THEN 'CU-' || o_custkey END AS t, CASE WHEN o_orderkey % 16 = 1 THEN 'CU-' || o_custkey END AS h, CASE WHEN o_orderkey % 16 = 2 THEN ['CU-' || o_custkey, 'CU-' || (o_custkey * 7 % {TICKETS})] END AS b,
        CASE WHEN o_orderstatus = 'F' THEN 'merged' WHEN o_orderkey % 5 = 0 THEN 'closed' WHEN o_orderkey % 5 = 1 THEN 'review' WHEN o_orderkey % 5 = 2 THEN 'draft' ELSE 'open' END AS state, {_AGO.format('o_orderkey % 150')} AS updated FROM orders),
    br AS (SELECT 's@' || s_suppkey AS ref, 'CU-' || (s_suppkey * 13 % {TICKETS}) AS k, {_AGO.format('s_suppkey % 60')} AS updated FROM supplier),
    cm AS (SELECT l_orderkey || '-' || l_linenumber AS ref, 'p' || (l_partkey % 97) AS author, CASE WHEN l_partkey % 50 = 0 THEN 'CU-' || (l_suppkey * 11 % {TICKETS}) END AS k, {_AGO.format('l_orderkey % 200')} AS made FROM lineitem),
    cd AS (SELECT DISTINCT 'c' || conv_id AS card, 'CU-' || (conv_id * 3 % {TICKETS}) AS key, 'pr/' || (conv_id * 5) AS url, {_AGO.format('conv_id % 40')} AS updated FROM conversations),
    ti AS (SELECT t AS ticket, 'pr_title' AS kind, url AS ref FROM pl WHERE t IS NOT NULL UNION SELECT h, 'pr_branch', url FROM pl WHERE h IS NOT NULL UNION SELECT unnest(b), 'pr_body', url FROM pl
        UNION SELECT k, 'branch_name', ref FROM br UNION SELECT k, 'commit', ref FROM cm WHERE k IS NOT NULL UNION SELECT key, 'card', card FROM cd UNION SELECT cd.key, 'card', url FROM cd JOIN pl USING (url))"""


@query("q16_ties", f"WITH {_SQL} SELECT * FROM ti")
def ties(spark, sf):
    s = sources(spark, sf)
    return projects.ties(*(s[n] for n in ("tickets", "pulls", "branches", "commits", "card_keys", "card_pulls")))


@query("q16_states", f"""WITH {_SQL}, known AS (SELECT key, state, updated FROM tk UNION ALL SELECT DISTINCT ticket, 'todo', NULL::TIMESTAMP FROM ti WHERE ticket NOT IN (SELECT key FROM tk) AND (kind <> 'commit' OR ref IN (SELECT ref FROM cm WHERE author = '{ME}'))),
    refs AS (SELECT url AS ref, state AS ps, updated AS made, 0 AS b FROM pl UNION ALL SELECT ref, NULL, updated, 1 FROM br UNION ALL SELECT ref, NULL, made, 0 FROM cm),
    n AS (SELECT ticket, count(*) FILTER (WHERE ps = 'merged') AS merged, count(*) FILTER (WHERE ps = 'review') AS review, count(*) FILTER (WHERE ps IN ('review', 'open', 'draft')) AS open, max(b) AS b, max(made) AS made FROM (SELECT DISTINCT ticket, ref FROM ti) JOIN refs USING (ref) GROUP BY ticket),
    h AS (SELECT key AS ticket, max(updated) AS held FROM cd GROUP BY key), j AS (SELECT k.key AS ticket, state, coalesce(merged, 0) AS merged, coalesce(review, 0) AS review, coalesce(open, 0) AS open, coalesce(b, 0) AS b, greatest(updated, made, held) AS updated FROM known k LEFT JOIN n ON n.ticket = k.key LEFT JOIN h ON h.ticket = k.key)
    SELECT ticket, CASE WHEN state = 'done' OR (merged > 0 AND open = 0) THEN 'done' WHEN review > 0 THEN 'close' WHEN open > 0 THEN 'progress' WHEN b > 0 AND state = 'todo' THEN 'progress' ELSE state END AS state, updated FROM j WHERE updated >= {NOW_SQL} - INTERVAL 120 DAY""")
def states(spark, sf):
    s = sources(spark, sf)
    tied = ties(spark, sf)
    rows = projects.with_unlisted(s["tickets"], tied, s["pulls"], s["commits"], ME)
    return projects.states(rows, tied, s["pulls"], s["branches"], s["commits"], s["card_keys"], now()).select("ticket", "state", "updated")


@query("q16_projects")
def model(spark, sf):
    """Every project with its counts, scores and members' closeness, as one viewer sees it."""
    return projects.build(**sources(spark, sf), me=ME, now=now()).projects
