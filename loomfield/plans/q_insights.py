"""Queries of insights over events; `now` is the newest event, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomfield.functions import numbers
from loomfield.operators import insights
from loomfield.plans.registry import query
from loomfield.session import table


def _now() -> Column:
    return F.to_timestamp(F.lit("2024-01-31"))

NOW_SQL = "TIMESTAMP '2024-01-31'"
_WINDOW = f"floor((epoch_us({NOW_SQL}) - epoch_us(ts)) / (7 * 86400000000))::BIGINT"


def events(spark, sf):
    return table(spark, sf, "events")


@query("a12_windows", f"SELECT {_WINDOW} AS win, count(*) AS calls, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events WHERE ts <= {NOW_SQL} GROUP BY win")
def windows(spark, sf):
    rows = events(spark, sf).withColumn("win", insights.window_back(F.col("ts"), _now())).where("win IS NOT NULL")
    return rows.groupBy("win").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


@query("a12_daily_zero_fill", "SELECT d::DATE::VARCHAR AS day, coalesce(sum(event_id), 0)::BIGINT AS event_id FROM range(DATE '2023-12-25', DATE '2024-02-06', INTERVAL 1 DAY) t(d) LEFT JOIN events ON ts::DATE = d::DATE GROUP BY day")
def daily(spark, sf):
    return insights.daily(events(spark, sf), "ts", "event_id", F.to_date(F.lit("2023-12-25")), F.to_date(F.lit("2024-02-05"))).withColumn("day", F.col("day").cast("string"))


@query("a13_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly(spark, sf):
    return events(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"))


_KINDS = {"purchase": "pr_merged", "signup": "thread_closed", "click": "review", "view": "commit"}
_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {v}" for k, v in _KINDS.items())
_GAME = f"g AS (SELECT {_WINDOW} AS win, {_COUNTS}, sum(value) * 10000 AS tok FROM events WHERE ts <= {NOW_SQL} GROUP BY win)"
_POINTS = "10 * pr_merged + 5 * thread_closed + 2 * review + least(\"commit\", 30)"


def _game(spark, sf):
    rows = events(spark, sf).withColumn("win", insights.window_back(F.col("ts"), _now())).where("win IS NOT NULL")
    counts = rows.groupBy("win").agg(*[F.count_if(F.col("event_type") == k).alias(v) for k, v in _KINDS.items()], (F.sum("value") * 10000).alias("tok"))
    return counts.withColumn("points", numbers.value_points({v: F.col(v) for v in _KINDS.values()}))


@query("a14_game", f"WITH {_GAME} SELECT win, ({_POINTS})::BIGINT AS points, round_even(100 * ({_POINTS}) / (greatest(tok, 1e6) / 1e6), 0)::BIGINT AS score FROM g")
def game(spark, sf):
    rows = _game(spark, sf)
    return rows.select("win", F.col("points").cast("long").alias("points"), numbers.score(F.col("points"), F.col("tok")).cast("long").alias("score"))


@query("a14_median", "SELECT event_type, round(median(value), 6) AS mid FROM events GROUP BY event_type")
def median(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.round(F.median("value"), 6).alias("mid"))


@query("a15_kpis", f"WITH {_GAME}, p AS (SELECT win, ({_POINTS})::DOUBLE AS points FROM g) SELECT c.points AS now, median(b.points) AS usual, c.points - median(b.points) AS delta FROM p c, p b WHERE c.win = 0 AND b.win BETWEEN 1 AND 4 GROUP BY c.points")
def kpis(spark, sf):
    rows = _game(spark, sf).agg(F.max(F.when(F.col("win") == 0, F.col("points").cast("double"))).alias("now"), F.median(F.when(F.col("win").between(1, 4), F.col("points").cast("double"))).alias("usual"))
    return rows.withColumn("delta", F.col("now") - F.col("usual"))


@query("w05_percentile_ties", """WITH c AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id), r AS (SELECT *, rank() OVER (ORDER BY n_events DESC) AS place, count(*) OVER (PARTITION BY n_events) AS same, count(*) OVER () AS n FROM c)
    SELECT user_id, n_events, place, round(100 * (n - place - same + 1 + 0.5 * same) / n, 6) AS percentile FROM r""")
def percentile(spark, sf):
    counts = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n_events"))
    out = insights.rank_share(counts.withColumn("g", F.lit(1)), ["g"], "n_events")
    return out.select("user_id", "n_events", F.col("place").cast("long").alias("place"), F.round("percentile", 6).alias("percentile"))


@query("w06_streaks", """WITH RECURSIVE cal AS (SELECT user_id, d::DATE AS d FROM (SELECT DISTINCT user_id FROM events) u, range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) t(d)),
    hit AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'purchase'),
    m AS (SELECT cal.user_id, cal.d, hit.d IS NOT NULL AS hit FROM cal LEFT JOIN hit ON hit.user_id = cal.user_id AND hit.d = cal.d WHERE cal.user_id IN (SELECT user_id FROM hit)),
    i AS (SELECT *, sum((NOT hit AND isodow(d) < 6 AND d <> DATE '2024-01-30')::INT) OVER (PARTITION BY user_id ORDER BY d) AS island FROM m),
    r AS (SELECT user_id, island, sum(hit::INT) AS n FROM i GROUP BY ALL) SELECT user_id, arg_max(n, island)::BIGINT AS current, max(n)::BIGINT AS best FROM r GROUP BY user_id""")
def streaks(spark, sf):
    days = events(spark, sf).where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"))
    return insights.streaks(days, ["user_id"], "day", F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-30")))


@query("a17_momentum", f"""WITH b AS (SELECT *, {_WINDOW} AS w FROM events),
    s AS (SELECT user_id, event_type, count(*) FILTER (WHERE w = 0) AS w0, count(*) FILTER (WHERE w = 1) AS w1, count(*) FILTER (WHERE w BETWEEN 1 AND 3) AS before,
        (epoch_us({NOW_SQL}) - epoch_us(max(ts))) / 8.64e10 AS quiet, count(*) FILTER (WHERE value > 100) AS open FROM b GROUP BY ALL)
    SELECT user_id, event_type, CASE WHEN w0 >= 2 AND 3 * w0 >= before THEN 'momentum' WHEN quiet >= 7 AND open > 0 THEN 'stalled' WHEN w0 > 0 OR w1 > 0 THEN 'cooling' ELSE 'quiet' END AS label FROM s""")
def momentum(spark, sf):
    rows = events(spark, sf).withColumn("w", insights.window_back(F.col("ts"), _now()))
    quiet = (F.unix_micros(_now()) - F.unix_micros(F.max("ts").cast("timestamp"))) / 8.64e10
    sums = rows.groupBy("user_id", "event_type").agg(*[F.count_if(F.col("w") == k).alias(f"w{k}") for k in range(6)], quiet.alias("quiet"), F.count_if(F.col("value") > 100).alias("open"))
    return sums.select("user_id", "event_type", insights.momentum([F.col(f"w{k}") for k in (5, 4, 3, 2, 1, 0)], F.col("quiet"), F.col("open")).alias("label"))


@query("a18_week", "SELECT date_trunc('week', ts)::DATE::VARCHAR AS week, isodow(ts) - 1 AS weekday, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def week(spark, sf):
    rows = events(spark, sf).where("event_type = 'purchase'")
    return rows.groupBy(F.to_date(F.date_trunc("week", "ts")).cast("string").alias("week"), F.weekday("ts").cast("long").alias("weekday")).agg(F.count("*").alias("n"))


@query("a21_usage_summary", """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.95)) THEN value END) AS p95 FROM s GROUP BY event_type""")
def usage(spark, sf):
    return insights.percentiles(events(spark, sf), ["event_type"], "value", (0.5, 0.95))


@query("a21_calls", "SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS calls, count(DISTINCT user_id) AS conns, sum((value < 1)::INT)::BIGINT AS empty FROM events GROUP BY ALL")
def calls(spark, sf):
    return events(spark, sf).groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("conns"), F.count_if(F.col("value") < 1).alias("empty"))


@query("a22_places", "SELECT user_id AS place, count(DISTINCT event_type) AS kinds, count(*) AS n, max(ts) AS last FROM events GROUP BY place ORDER BY n DESC, place LIMIT 25")
def places(spark, sf):
    rows = events(spark, sf).groupBy(F.col("user_id").alias("place")).agg(F.count_distinct("event_type").alias("kinds"), F.count("*").alias("n"), F.max("ts").alias("last"))
    return rows.orderBy(F.desc("n"), "place").limit(25)


@query("a20_badges", f"WITH w AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS closed, count(*) FILTER (WHERE event_type = 'click') AS reviews FROM events WHERE ts > {NOW_SQL} - INTERVAL 7 DAY GROUP BY user_id) SELECT user_id, closed >= 5 AS closer, reviews >= 5 AS reviewer FROM w")
def badges(spark, sf):
    rows = events(spark, sf).where(F.col("ts") > _now() - F.expr("INTERVAL 7 DAYS")).groupBy("user_id")
    return rows.agg((F.count_if(F.col("event_type") == "purchase") >= 5).alias("closer"), (F.count_if(F.col("event_type") == "click") >= 5).alias("reviewer"))


@query("a25_decay", f"SELECT user_id, round(sum(ln(1 + value) * pow(0.5, (epoch({NOW_SQL}) - epoch(ts)) / 86400 / 120)), 5) AS weight FROM events GROUP BY user_id")
def decay(spark, sf):
    age = (F.unix_micros(_now()) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6 / 86400
    return events(spark, sf).groupBy("user_id").agg(F.round(F.sum(F.log1p("value") * numbers.half_life(age, 120, 0.25)), 5).alias("weight"))


@query("x07_output_events", """SELECT 'order' AS kind, o_orderkey AS ref, o_orderdate AS at FROM orders UNION ALL SELECT 'ship', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem
    UNION ALL SELECT event_type, event_id, ts FROM events WHERE event_type <> 'view' UNION ALL SELECT 'fallback', event_id, ts FROM events WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'missing') AND event_type = 'view'""")
def output_events(spark, sf):
    e = events(spark, sf)
    parts = [
        table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("ref"), F.col("o_orderdate").alias("at")),
        table(spark, sf, "lineitem").select(F.lit("ship").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.col("l_shipdate").alias("at")),
        e.where("event_type <> 'view'").select(F.col("event_type").alias("kind"), F.col("event_id").alias("ref"), F.col("ts").alias("at")),
        e.where("event_type = 'view'").join(e.where("event_type = 'missing'").select(F.lit(1).alias("x")).limit(1), F.lit(True), "left_anti").select(F.lit("fallback").alias("kind"), F.col("event_id").alias("ref"), F.col("ts").alias("at")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("x55_attribution", """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), n AS (
    SELECT p.event_id, e.event_id AS next, row_number() OVER (PARTITION BY p.event_id ORDER BY e.ts, e.event_id) AS r FROM p JOIN events e ON e.user_id = p.user_id AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 6 HOUR)
    SELECT event_id, count(*) AS followed FROM n WHERE r <= 5 GROUP BY event_id""")
def attribution(spark, sf):
    p = events(spark, sf).where("event_type = 'click'").select(F.col("event_id").alias("p_id"), F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts"))
    e = events(spark, sf)
    hit = p.join(e, (p.p_user == e.user_id) & (e.ts > p.p_ts) & (e.ts <= p.p_ts + F.expr("INTERVAL 6 HOURS")))
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("p_id").orderBy("ts", "event_id"))).where("r <= 5")
    return ranked.groupBy(F.col("p_id").alias("event_id")).agg(F.count("*").alias("followed"))


@query("x52_inherit", "SELECT user_id, event_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS chain, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS carried FROM events")
def inherit(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf).select("user_id", "event_id", F.sum((F.col("event_type") == "signup").cast("long")).over(w).alias("chain"), F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w).alias("carried"))
