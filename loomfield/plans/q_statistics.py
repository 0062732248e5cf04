"""Queries of a person's statistics. Events stand for usage, output and reviews, orders for cards, their lines for activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.operators import statistics as st
from loomfield.plans.registry import query
from loomfield.session import table

NOW_SQL = "TIMESTAMP '2024-01-31'"
PRICES = {"alpha": (3.0, 15.0, 0.3), "alpha-large": (5.0, 25.0, 0.5), "alpha-small": (0.8, 4.0, 0.08)}
_KINDS = {"purchase": "pr_merged", "signup": "thread_closed", "click": "review", "view": "commit", "error": "deployed"}


def now() -> Column:
    return F.to_timestamp(F.lit("2024-01-31"))


def usage(spark, sf) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, ("alpha-large-2", "Alpha-small-1", "alpha", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    part = lambda n: F.floor(F.col("value") * n)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("person"), (F.col("user_id") * 10 + F.col("event_id") % 7).alias("session"), F.date_trunc("hour", "ts").alias("hour"), model.alias("model"), F.lit(1).alias("calls"),
        part(1000).alias("input"), part(100).alias("output"), part(500).alias("cache_write"), part(9000).alias("cache_read"), F.when(F.col("event_id") % 3 == 0, part(500)).otherwise(0).alias("cache_write_1h"),
    )


def outputs(spark, sf) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), F.col("event_type"))
    return table(spark, sf, "events").select(F.col("user_id").alias("person"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 12).alias("repo"), F.floor("value").alias("n"))


def reviews(spark, sf) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").where("event_type = 'click'").select(
        F.col("user_id").alias("person"), ((F.col("user_id") * 7 + F.col("event_id")) % 150).alias("author"), (F.col("event_id") % 12).alias("repo"),
        F.timestamp_micros(F.unix_micros(at) - F.floor(F.col("value") * 3600) * 1_000_000).alias("created"), at.alias("at"),
    )


def near(spark, sf) -> DataFrame:
    """Closeness of two users: reviews between them, either way."""
    r = reviews(spark, sf).select("person", F.col("author").alias("other"))
    return r.union(r.select("other", "person")).where("person <> other").groupBy("person", "other").agg(F.count("*").cast("double").alias("closeness"))


def cards(spark, sf) -> DataFrame:
    left = table(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("n_left"))
    rows = table(spark, sf, "orders").join(left, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("loose_ends")
    updated = F.timestamp_seconds(F.lit(1703030400) + (F.col("o_orderkey") * 37 % 42) * 86400 + F.col("o_orderkey") * 1009 % 86400)
    return rows.select((F.col("o_custkey") % 150).alias("person"), F.col("o_orderkey").alias("card"), state.alias("state"), updated.alias("updated"), F.concat(F.lit("order "), "o_orderpriority").alias("title"), F.coalesce("n_left", F.lit(0)).alias("n_left"), (F.col("o_orderkey") % 12).alias("repo"))


def activity(spark, sf) -> DataFrame:
    day = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_partkey")) % 42
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("card"), F.timestamp_seconds(F.lit(1703030400) + day * 86400).alias("at"))


def _people(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("person")).distinct()


def _game(spark, sf) -> DataFrame:
    return st.game(st.token_windows(usage(spark, sf), _people(spark, sf), now(), PRICES), outputs(spark, sf), now())


_WIN = f"floor((epoch_us({NOW_SQL}) - epoch_us({{}})) / (7 * 86400000000))::BIGINT"
_UNITS = """CASE lower(model) WHEN 'alpha-large-2' THEN 50000 * 100 * i + 250000 * 100 * o + 50000 * 125 * (cw - c1) + 50000 * 200 * c1 + 5000 * 100 * cr
    WHEN 'alpha-small-1' THEN 8000 * 100 * i + 40000 * 100 * o + 8000 * 125 * (cw - c1) + 8000 * 200 * c1 + 800 * 100 * cr
    WHEN 'alpha' THEN 30000 * 100 * i + 150000 * 100 * o + 30000 * 125 * (cw - c1) + 30000 * 200 * c1 + 3000 * 100 * cr END"""
_EVENTS = f"""u AS (SELECT user_id AS person, user_id * 10 + event_id % 7 AS session, date_trunc('hour', ts) AS hour, CASE event_id % 4 WHEN 0 THEN 'alpha-large-2' WHEN 1 THEN 'Alpha-small-1' WHEN 2 THEN 'alpha' ELSE 'other' END AS model,
        floor(value * 1000)::BIGINT AS i, floor(value * 100)::BIGINT AS o, floor(value * 500)::BIGINT AS cw, floor(value * 9000)::BIGINT AS cr, CASE WHEN event_id % 3 = 0 THEN floor(value * 500)::BIGINT ELSE 0 END AS c1 FROM events),
    up AS (SELECT *, i + o + cw + cr AS total, {_UNITS} AS units FROM u),
    o AS (SELECT user_id AS person, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS kind, ts AS made, event_id % 12 AS repo, floor(value)::BIGINT AS n FROM events)"""
_TOKENS = f"""{_EVENTS}, tw AS (SELECT p.person, w.win, count(units) + count(*) FILTER (WHERE x.person IS NOT NULL AND units IS NULL) AS calls, coalesce(sum(total), 0)::BIGINT AS total, coalesce(sum(units), 0)::DOUBLE / 1e12 AS price, coalesce(sum(total) FILTER (WHERE units IS NULL), 0)::BIGINT AS unpriced,
        CASE WHEN sum(i + cw + cr) > 0 THEN round(sum(cr) / sum(i + cw + cr), 4) END AS cache_share, coalesce(sum(i)::DOUBLE + 5.0::DOUBLE * sum(o) + 1.25::DOUBLE * sum(cw) + 0.1::DOUBLE * sum(cr), 0) AS wtok
    FROM (SELECT DISTINCT user_id AS person FROM events) p CROSS JOIN range(8) w(win) LEFT JOIN (SELECT *, {_WIN.format("hour + INTERVAL 30 MINUTE")} AS win FROM up) x ON x.person = p.person AND x.win = w.win GROUP BY p.person, w.win)"""
_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("pr_merged", "thread_closed", "review", "commit"))
_GAME = f"""{_TOKENS}, ow AS (SELECT person, {_WIN.format("made")} AS win, {_COUNTS}, sum(CASE WHEN kind = 'deployed' THEN n ELSE 0 END)::BIGINT AS lines FROM o GROUP BY ALL),
    g0 AS (SELECT tw.*, coalesce(pr_merged, 0) AS pr_merged, coalesce(thread_closed, 0) AS thread_closed, coalesce(review, 0) AS review, coalesce("commit", 0) AS commits, coalesce(lines, 0) AS lines FROM tw LEFT JOIN ow USING (person, win)),
    g1 AS (SELECT *, 10 * pr_merged + 5 * thread_closed + 2 * review + least(commits, 30) AS points, greatest(wtok, 1e6) / 1e6 AS m, median(CASE WHEN wtok > 0 THEN wtok END) OVER (PARTITION BY person) AS usual FROM g0),
    g AS (SELECT *, CASE WHEN wtok > 0 THEN round_even(100 * points / m, 0)::BIGINT END AS score, CASE WHEN wtok > 0 THEN round(lines / m, 1) END AS lines_per_m, coalesce(wtok >= 0.25 * usual, false) AND wtok > 0 AS counts FROM g1)"""


@query("q10_tokens", f"WITH {_TOKENS} SELECT * REPLACE (round(wtok, 3) AS wtok) FROM tw")
def tokens(spark, sf):
    return st.token_windows(usage(spark, sf), _people(spark, sf), now(), PRICES).select("person", "win", F.col("calls").cast("long").alias("calls"), "total", "price", "unpriced", "cache_share", F.round("wtok", 3).alias("wtok"))


@query("q10_token_days", f"""WITH {_EVENTS} SELECT p.person, d::DATE::VARCHAR AS day, coalesce(sum(total), 0)::BIGINT AS total, coalesce(sum(units), 0)::DOUBLE / 1e12 AS price FROM (SELECT DISTINCT user_id AS person FROM events) p
    CROSS JOIN range(DATE '2023-12-07', DATE '2024-02-01', INTERVAL 1 DAY) t(d) LEFT JOIN up ON up.person = p.person AND up.hour::DATE = d::DATE GROUP BY ALL""")
def token_days(spark, sf):
    return st.token_days(usage(spark, sf), _people(spark, sf), now(), PRICES).select("person", F.col("day").cast("string").alias("day"), "total", "price")


@query("q10_token_models", f"WITH {_EVENTS} SELECT person, model, count(*) AS calls, sum(total)::BIGINT AS total, coalesce(sum(total) FILTER (WHERE hour >= {NOW_SQL} - INTERVAL 28 DAY), 0)::BIGINT AS recent, count(DISTINCT session) AS sessions, sum(units)::DOUBLE / 1e12 AS price FROM up GROUP BY person, model")
def token_models(spark, sf):
    return st.token_models(usage(spark, sf), now(), PRICES).select("person", "model", F.col("calls").cast("long").alias("calls"), "total", "recent", "sessions", "price")


@query("q10_game", f"WITH {_GAME} SELECT person, win, pr_merged, thread_closed, review, commits, lines, points::BIGINT AS points, score, lines_per_m, counts FROM g")
def game(spark, sf):
    return _game(spark, sf).select("person", "win", "pr_merged", "thread_closed", "review", F.col("commit").alias("commits"), "lines", "points", "score", "lines_per_m", "counts")


@query("q10_record", f"""WITH {_GAME}, cal AS (SELECT person, d::DATE AS d FROM (SELECT DISTINCT person FROM o) p, range(DATE '2023-12-07', DATE '2024-02-01', INTERVAL 1 DAY) t(d)),
    hit AS (SELECT DISTINCT person, made::DATE AS d FROM o WHERE kind IN ('pr_merged', 'thread_closed')),
    isl AS (SELECT cal.person, cal.d, hit.d IS NOT NULL AS hit, sum((hit.d IS NULL AND isodow(cal.d) < 6 AND cal.d <> DATE '2024-01-31')::INT) OVER (PARTITION BY cal.person ORDER BY cal.d) AS island FROM cal LEFT JOIN hit USING (person, d)),
    r AS (SELECT person, arg_max(k, island) AS streak, max(k) AS best_streak FROM (SELECT person, island, sum(hit::INT)::BIGINT AS k FROM isl GROUP BY ALL) GROUP BY person),
    b AS (SELECT person, max(score) FILTER (WHERE counts) AS best_score, max(lines_per_m) FILTER (WHERE counts) AS best_lines FROM g GROUP BY person)
    SELECT g.person, max(score) FILTER (WHERE win = 0) AS score, max(points) FILTER (WHERE win = 0)::BIGINT AS points, median(score) FILTER (WHERE win BETWEEN 1 AND 4) AS prev_score, max(best_score) AS best_score, min(win) FILTER (WHERE counts AND score = best_score)::BIGINT AS best_score_win,
        max(best_lines) AS best_lines_per_m, min(win) FILTER (WHERE counts AND lines_per_m = best_lines)::BIGINT AS best_lines_per_m_win, max(streak) AS streak, max(best_streak) AS best_streak, max(thread_closed) FILTER (WHERE win = 0) >= 5 AS has_closer,
        max(review) FILTER (WHERE win = 0) >= 5 AS has_reviewer, max(streak) >= 5 AS has_streak,
        coalesce(max(wtok / nullif(pr_merged, 0)) FILTER (WHERE win = 0) < median(wtok / nullif(pr_merged, 0)) FILTER (WHERE win BETWEEN 1 AND 4), false) AS has_lean
    FROM g JOIN r ON r.person = g.person JOIN b ON b.person = g.person GROUP BY g.person""")
def record(spark, sf):
    out = st.record(_game(spark, sf), outputs(spark, sf), now())
    return out.select("person", "score", "points", "prev_score", "best_score", "best_score_win", "best_lines_per_m", "best_lines_per_m_win", "streak", "best_streak", "has_closer", "has_reviewer", "has_streak", "has_lean")


@query("q10_kpis", f"""WITH {_GAME}, k AS (SELECT person, win, unnest(['tokens', 'cost', 'cache', 'per_commit', 'per_thread']) AS item, unnest([total::DOUBLE, price, cache_share, wtok / nullif(commits, 0), wtok / nullif(thread_closed, 0)]) AS v FROM g),
    a AS (SELECT person, item, max(CASE WHEN item LIKE 'per%' AND v = 0 THEN NULL ELSE v END) FILTER (WHERE win = 0) AS value, median(CASE WHEN item LIKE 'per%' AND v = 0 THEN NULL ELSE v END) FILTER (WHERE win BETWEEN 1 AND 4) AS base FROM k GROUP BY ALL)
    SELECT person, item, round(value, 6) AS value, round(base, 6) AS base, round(CASE WHEN base <> 0 THEN (value - base) / base END, 6) AS delta FROM a""")
def kpis(spark, sf):
    return st.kpis(_game(spark, sf)).select("person", "item", F.round("value", 6).alias("value"), F.round("base", 6).alias("base"), F.round("delta", 6).alias("delta"))


_REVIEWS = f"""{_EVENTS}, rv AS (SELECT user_id AS person, (user_id * 7 + event_id) % 150 AS author, event_id % 12 AS repo, floor(value * 3600)::BIGINT / 3600 AS hours, ts AS made FROM events WHERE event_type = 'click'),
    nr AS (SELECT person, other, count(*) AS c FROM (SELECT person, author AS other FROM rv UNION ALL SELECT author, person FROM rv) WHERE person <> other GROUP BY ALL)"""


@query("q10_peers", f"""WITH {_REVIEWS}, ring AS (SELECT person, other AS member FROM nr QUALIFY row_number() OVER (PARTITION BY person ORDER BY c DESC, other) <= 10),
    circle AS (SELECT * FROM ring UNION SELECT person, person FROM ring), od AS (SELECT * FROM o WHERE made >= {NOW_SQL} - INTERVAL 28 DAY AND made <= {NOW_SQL} AND kind IN ('commit', 'pr_merged', 'deployed')),
    rr AS (SELECT * FROM rv WHERE made >= {NOW_SQL} - INTERVAL 28 DAY AND made <= {NOW_SQL} AND person <> author),
    acts AS (SELECT person AS member, repo, (kind = 'pr_merged')::INT AS prs_merged, 0 AS reviews, (kind = 'commit')::INT AS commits, CASE WHEN kind = 'deployed' THEN n ELSE 0 END AS lines FROM od UNION ALL SELECT person, repo, 0, 1, 0, 0 FROM rr),
    shared AS (SELECT DISTINCT person, repo FROM ring JOIN acts USING (member)),
    sums AS (SELECT c.person, c.member, coalesce(sum(prs_merged), 0) AS prs_merged, coalesce(sum(reviews), 0) AS reviews, coalesce(sum(commits), 0) AS commits, coalesce(sum(lines), 0) AS lines FROM circle c LEFT JOIN (SELECT * FROM acts JOIN shared USING (repo)) a ON a.person = c.person AND a.member = c.member GROUP BY ALL),
    turn AS (SELECT c.person, c.member, round(median(hours), 1) AS v FROM circle c JOIN rr ON rr.person = c.member JOIN shared s ON s.person = c.person AND s.repo = rr.repo WHERE hours >= 0 GROUP BY ALL),
    l AS (SELECT person, member, unnest(['prs_merged', 'reviews', 'commits', 'lines']) AS item, unnest([prs_merged::DOUBLE, reviews::DOUBLE, commits::DOUBLE, lines::DOUBLE]) AS v, 1 AS sign FROM sums UNION ALL SELECT person, member, 'turnaround', v, -1 FROM turn),
    m AS (SELECT *, max(CASE WHEN person = member THEN v END) OVER (PARTITION BY person, item) AS mine FROM l),
    a AS (SELECT person, item, any_value(mine) AS mine, count(*) FILTER (WHERE person <> member) AS others, median(v) FILTER (WHERE person <> member) AS middle, count(*) FILTER (WHERE person <> member AND sign * (v - mine) > 0) AS above,
        count(*) FILTER (WHERE person <> member AND v = mine) AS same, count(*) FILTER (WHERE person <> member AND sign * (v - mine) < 0) AS beaten FROM m GROUP BY ALL)
    SELECT person, item, mine, others, round(middle, 3) AS middle, CASE WHEN mine IS NOT NULL AND others > 0 THEN above + 1 END AS place, CASE WHEN mine IS NOT NULL AND others > 0 THEN round_even(100 * (beaten + 0.5::DOUBLE * same) / others, 0)::BIGINT END AS percentile FROM a""")
def peers(spark, sf):
    return st.peers(near(spark, sf), outputs(spark, sf), reviews(spark, sf), now()).withColumn("middle", F.round("middle", 3))


_CARDS = """c AS (SELECT o_custkey % 150 AS person, o_orderkey AS card, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'loose_ends' END AS state,
        make_timestamp((1703030400 + (o_orderkey * 37 % 42) * 86400 + o_orderkey * 1009 % 86400) * 1000000) AS updated, 'order ' || o_orderpriority AS title, coalesce(n_left, 0) AS n_left, o_orderkey % 12 AS repo
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_left FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON l_orderkey = o_orderkey),
    act AS (SELECT l_orderkey AS card, make_timestamp((1703030400 + ((l_orderkey * 37 + l_linenumber * 11 + l_partkey) % 42) * 86400) * 1000000) AS made FROM lineitem)"""
_BACK = f"(epoch_us({NOW_SQL}) - epoch_us({{}})) / 8.64e10"
_STATUS = """CASE WHEN s[6] >= 2 AND 3 * s[6] >= s[3] + s[4] + s[5] THEN 'momentum' WHEN quiet >= 7 AND n_left > 0 THEN 'stalled' WHEN s[6] > 0 OR s[5] > 0 THEN 'cooling' ELSE 'quiet' END AS status"""
_SERIES = "[" + ", ".join(f"count(*) FILTER (WHERE {_WIN.format('made')} = {5 - k})" for k in range(6)) + "]"


@query("q10_momentum", f"""WITH {_CARDS}, a AS (SELECT card, {_SERIES} AS s, max(made) AS last FROM act GROUP BY card),
    j AS (SELECT c.*, coalesce(s, [0, 0, 0, 0, 0, 0]) AS s, {_BACK.format("coalesce(last, updated)")} AS quiet FROM c LEFT JOIN a USING (card) WHERE state <> 'closed')
    SELECT person, card, array_to_string(s, ',') AS series, round(quiet, 1) AS quiet_days, n_left, {_STATUS} FROM j""")
def momentum(spark, sf):
    return st.momentum_cards(cards(spark, sf), activity(spark, sf), now()).select("person", "card", F.array_join(F.col("series").cast("array<string>"), ",").alias("series"), "quiet_days", "n_left", "status")


@query("q10_momentum_repos", f"""WITH {_EVENTS}, {_CARDS}, a AS (SELECT person, repo, {_SERIES} AS s, {_BACK.format("max(made)")} AS quiet FROM o WHERE kind IN ('commit', 'pr_merged') GROUP BY ALL),
    l AS (SELECT person, repo, sum(n_left)::BIGINT AS n_left FROM c WHERE state <> 'closed' GROUP BY ALL), j AS (SELECT person, repo, s, quiet, coalesce(n_left, 0) AS n_left FROM a LEFT JOIN l USING (person, repo) WHERE list_sum(s) > 0)
    SELECT person, repo, array_to_string(s, ',') AS series, round(quiet, 1) AS quiet_days, n_left, {_STATUS} FROM j""")
def momentum_repos(spark, sf):
    return st.momentum_repos(cards(spark, sf), outputs(spark, sf), now()).select("person", "repo", F.array_join(F.col("series").cast("array<string>"), ",").alias("series"), "quiet_days", "n_left", "status")


@query("q10_week", f"""WITH {_CARDS}, k AS (SELECT *, CASE WHEN state = 'closed' THEN CASE WHEN updated >= DATE '2024-01-29' THEN 0 ELSE floor((epoch_us(TIMESTAMP '2024-01-29') - epoch_us(updated)) / 6.048e11)::BIGINT + 1 END END AS back FROM c),
    w AS (SELECT person, count(*) FILTER (WHERE back = 0) AS closed, count(*) FILTER (WHERE back = 1) AS last_week, greatest(count(*) FILTER (WHERE back = 0), count(*) FILTER (WHERE back = 1), count(*) FILTER (WHERE back = 2), count(*) FILTER (WHERE back = 3)) AS best_week,
        count(DISTINCT CASE WHEN back = 0 THEN updated::DATE END) AS days, count(*) FILTER (WHERE state <> 'closed') AS n_open FROM k GROUP BY person)
    SELECT person, closed, last_week, best_week, n_open, closed >= 1 AS has_first, closed >= 5 AS has_closer, closed > last_week AS has_beat, days >= 3 AS has_daily, closed > 0 AND n_open = 0 AS has_clean, least(days, 3) AS progress_daily, greatest(1, closed + n_open) AS goal_clean FROM w""")
def week(spark, sf):
    return st.week(cards(spark, sf), now()).select("person", "closed", "last_week", "best_week", "n_open", *[f"has_{a}" for a in ("first", "closer", "beat", "daily", "clean")], "progress_daily", "goal_clean")


@query("q10_closest", f"WITH {_CARDS} SELECT person, card, n_left, row_number() OVER (PARTITION BY person ORDER BY n_left = 0, n_left, updated DESC, card) AS place FROM c WHERE state <> 'closed' QUALIFY place <= 8")
def closest(spark, sf):
    return st.closest(cards(spark, sf)).select("person", "card", "n_left", "place")


@query("q10_stats")
def stats(spark, sf):
    """The whole page, of all repositories."""
    return st.page(usage(spark, sf), outputs(spark, sf), reviews(spark, sf), near(spark, sf), cards(spark, sf), activity(spark, sf), now(), PRICES)
