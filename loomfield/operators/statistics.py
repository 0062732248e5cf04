"""The statistics of a person's work: tokens and their price, the output they bought, records, peers, momentum, the week.

Everything is computed for all persons at once, from tables that are already keyed by person:

- usage: person, session, hour, model, calls, input, output, cache_write, cache_read, cache_write_1h
- outputs: person, kind, at, repo, n (the lines of a `deployed` row, else 1)
- reviews: person (who reviewed), author, repo, created, at
- near: person, other, closeness
- cards: person, card, state, updated, title, n_left, repo; activity: card, at

Windows are tumbling weeks that end at `now`, 0 being the last one. A null person, time or kind takes part in nothing; null
amounts count as 0. Large tables are aggregated to (person, window) before anything is joined, so only rows of the result meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import numbers
from loomfield.operators import insights

WINDOWS = 8
AMOUNTS = ("calls", "input", "output", "cache_write", "cache_read", "cache_write_1h")
SIDES = ("input", "output", "cache_write", "cache_read")
#: Goals of the badges, share of the usual tokens that a record needs, size of the circle of peers.
GOALS = {"closer": 5, "lean": 1, "reviewer": 5, "streak": 5}
BEST_SHARE = 0.25
PEERS = 10
CLOSED = ("closed", "complete")
OPEN = ("open", "loose_ends")
PAST = ("closed", "complete", "closing", "forgotten")


def cost(model: Column, prices: dict[str, tuple[float, float, float]]) -> Column:
    """Price in 1e-12 dollars of the amounts in the row, exact; null if no prefix of the model has one.

    `prices`: prefix to dollars a million for (input, output, cache read); the longest prefix wins. A cache write costs
    1.25 of an input token, one for an hour twice.
    """
    name = F.regexp_replace(F.lower(model), r"^(us\.)?anthropic\.", "")
    n = {a: F.coalesce(F.col(a), F.lit(0)).cast("decimal(20,0)") for a in AMOUNTS}
    short = F.greatest(n["cache_write"] - n["cache_write_1h"], F.lit(0).cast("decimal(20,0)"))
    out = F.lit(None).cast("decimal(38,0)")
    for prefix in sorted(prices, key=len):  # the last one that is wrapped around is the longest
        i, o, r = (round(p * 10_000) for p in prices[prefix])
        parts = [n["input"] * (100 * i), n["output"] * (100 * o), short * (125 * i), n["cache_write_1h"] * (200 * i), n["cache_read"] * (100 * r)]
        out = F.when(name.startswith(prefix), reduce(lambda a, b: a + b, parts).cast("decimal(38,0)")).otherwise(out)
    return out


def _sums(usage: DataFrame, by: list, prices: dict) -> DataFrame:
    """Amounts, `total`, `price` (dollars) and `unpriced` tokens by `by`; summed by model first, as the price is by model."""
    rows = usage.groupBy(*by, "model").agg(*[F.sum(F.coalesce(F.col(a), F.lit(0))).alias(a) for a in AMOUNTS])
    total = sum((F.col(a) for a in SIDES[1:]), F.col(SIDES[0]))
    rows = rows.withColumns({"total": total, "units": cost(F.col("model"), prices)})
    keys = [k for k in rows.columns if k not in (*AMOUNTS, "model", "total", "units")]
    return rows.groupBy(*keys).agg(
        *[F.sum(a).alias(a) for a in AMOUNTS], F.sum("total").alias("total"),
        (F.coalesce(F.sum("units").cast("double"), F.lit(0.0)) / 1e12).alias("price"),
        F.sum(F.when(F.col("units").isNull(), F.col("total")).otherwise(0)).alias("unpriced"),
    )


def _filled(people: DataFrame, name: str, values: Column) -> DataFrame:
    return people.select("person", F.explode(values).alias(name))


def token_windows(usage: DataFrame, people: DataFrame, now: Column, prices: dict) -> DataFrame:
    """(person, win): amounts, price, share of cache reads on the input side, weighted tokens; zeros where nothing was used."""
    half = F.col("hour").cast("timestamp") + F.expr("INTERVAL 30 MINUTES")  # an hour counts where its middle lies
    rows = usage.withColumn("win", insights.window_back(half, now)).where(F.col("win") < WINDOWS)
    rows = _sums(rows, ["person", "win"], prices)
    out = _filled(people, "win", F.sequence(F.lit(0).cast("long"), F.lit(WINDOWS - 1).cast("long"))).join(rows, ["person", "win"], "left")
    out = out.fillna(0)
    side = F.col("input") + F.col("cache_write") + F.col("cache_read")
    return out.withColumns({
        "cache_share": F.when(side > 0, F.round(F.col("cache_read") / side, 4)),
        "wtok": numbers.weighted_tokens(input="input", output="output", cache_write="cache_write", cache_read="cache_read"),
    })


def token_days(usage: DataFrame, people: DataFrame, now: Column, prices: dict) -> DataFrame:
    """(person, day) for each of the last 56 days: amounts and price, zeros for days without use."""
    first, last = F.date_sub(F.to_date(now), WINDOWS * 7 - 1), F.to_date(now)
    rows = usage.where(F.to_date("hour").between(first, last))
    rows = _sums(rows, ["person", F.to_date("hour").alias("day")], prices)
    return _filled(people, "day", F.sequence(first, last)).join(rows, ["person", "day"], "left").fillna(0)


def token_models(usage: DataFrame, now: Column, prices: dict) -> DataFrame:
    """(person, model): amounts, sessions, price (null: none known) and `recent`, the total of the last four weeks."""
    total = sum((F.coalesce(F.col(a), F.lit(0)) for a in SIDES[1:]), F.coalesce(F.col(SIDES[0]), F.lit(0)))
    recent = F.col("hour").cast("timestamp") >= now - F.expr("INTERVAL 28 DAYS")
    each = usage.groupBy("person", "model", "session").agg(*[F.sum(F.coalesce(F.col(a), F.lit(0))).alias(a) for a in AMOUNTS], F.sum(total).alias("total"), F.sum(F.when(recent, total).otherwise(0)).alias("recent"))
    rows = each.groupBy("person", "model").agg(*[F.sum(a).alias(a) for a in (*AMOUNTS, "total", "recent")], F.count("session").alias("sessions"))
    return rows.withColumn("price", cost(F.col("model"), prices).cast("double") / 1e12)


def game(tokens: DataFrame, outputs: DataFrame, now: Column) -> DataFrame:
    """`token_windows` with the counts of each kind of output, points, score, deployed lines, and whether the window may be a record.

    A window may be one if it has a quarter of the median tokens of the person's windows that have any.
    """
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    rows = outputs.withColumn("win", insights.window_back(F.col("at"), now)).where(F.col("win") < WINDOWS)
    lines = F.sum(F.when(F.col("kind") == "deployed", F.coalesce("n", F.lit(0))).otherwise(0)).alias("lines")
    out = tokens.join(rows.groupBy("person", "win").agg(*map(n, numbers.POINTS), lines), ["person", "win"], "left").fillna(0, [*numbers.POINTS, "lines"])
    out = out.withColumn("points", numbers.value_points({k: F.col(k) for k in numbers.POINTS}).cast("long"))
    used = F.when(F.col("wtok") > 0, F.greatest("wtok", F.lit(numbers.SCORE_FLOOR)) / 1e6)
    out = out.withColumns({"score": numbers.score(F.col("points"), F.col("wtok")).cast("long"), "lines_per_m": F.round(F.col("lines") / used, 1)})
    usual = F.median(F.when(F.col("wtok") > 0, F.col("wtok"))).over(Window.partitionBy("person"))
    return out.withColumn("counts", F.coalesce(F.col("wtok") >= BEST_SHARE * usual, F.lit(False)) & F.col("score").isNotNull())


def _best(value: str) -> list[Column]:
    """The highest value among windows that count, and the latest window that has it."""
    best = F.when(F.col("counts") & F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col("win")).alias("w")))
    return [F.max(best)["v"].alias(f"best_{value}"), (-F.max(best)["w"]).alias(f"best_{value}_win")]


def record(rows: DataFrame, outputs: DataFrame, now: Column) -> DataFrame:
    """A row a person of `game` rows: score against the four windows before, records, streaks, badges with their progress."""
    cur, prev = F.col("win") == 0, F.col("win").between(1, 4)
    one = lambda c, name=None: F.max(F.when(cur, F.col(c))).alias(name or c)
    pr = F.when((F.col("pr_merged") > 0), F.col("wtok") / F.col("pr_merged"))
    out = rows.groupBy("person").agg(
        one("score"), one("points"), one("lines"), one("lines_per_m"), one("thread_closed", "closed"), one("review", "reviews"),
        F.median(F.when(prev, F.col("score"))).alias("prev_score"), F.median(F.when(prev, F.col("lines_per_m"))).alias("prev_lines_per_m"),
        *_best("score"), *_best("lines_per_m"),
        F.coalesce(F.max(F.when(cur, pr)) < F.median(F.when(prev, pr)), F.lit(False)).cast("int").alias("lean"),
    )
    today = F.to_date(now)
    shipped = outputs.where(F.col("kind").isin("pr_merged", "thread_closed")).select("person", F.to_date("at").alias("day"))
    runs = insights.streaks(shipped, ["person"], "day", F.date_sub(today, WINDOWS * 7 - 1), today)
    out = out.join(runs.withColumnsRenamed({"current": "streak", "best": "best_streak"}), "person", "left").fillna(0, ["streak", "best_streak"])
    have = {"closer": "closed", "lean": "lean", "reviewer": "reviews", "streak": "streak"}
    return out.withColumns({f"badge_{b}": F.least(F.col(have[b]), F.lit(goal)) for b, goal in GOALS.items()} | {f"has_{b}": F.col(have[b]) >= goal for b, goal in GOALS.items()}).drop("lean")


def kpis(rows: DataFrame) -> DataFrame:
    """(person, item): the value of the last window, the median of the four before and the relative change (null if that is 0)."""
    per = lambda kind: F.when((F.col(kind) > 0) & (F.col("wtok") > 0), F.col("wtok") / F.col(kind))
    tiles = {"tokens": F.col("total").cast("double"), "cost": F.col("price"), "cache": F.col("cache_share"), "per_commit": per("commit"), "per_thread": per("thread_closed")}
    long = rows.select("person", "win", F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("v")) for k, v in tiles.items()])).alias("t")).select("person", "win", "t.*")
    out = long.groupBy("person", "item").agg(F.max(F.when(F.col("win") == 0, F.col("v"))).alias("value"), F.median(F.when(F.col("win").between(1, 4), F.col("v"))).alias("base"))
    return out.withColumn("delta", F.when(F.col("base") != 0, (F.col("value") - F.col("base")) / F.col("base")))


def middle(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value): the median of unbounded groups, by a sort that spills; nulls don't count."""
    w = Window.partitionBy(*by)
    ranked = rows.where(F.col(value).isNotNull()).select(*by, value).withColumns({"i": F.row_number().over(w.orderBy(value)), "n": F.count("*").over(w)})
    return ranked.where(F.col("i").between(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)).groupBy(*by).agg(F.avg(value).alias(value))


def peers(near: DataFrame, outputs: DataFrame, reviews: DataFrame, now: Column, days: int = 28) -> DataFrame:
    """(person, item): own value, rank, percentile and the median of the ten nearest, in repositories where one of those works.

    Items: prs_merged, reviews, commits, lines (a person without any has 0) and turnaround, the median hours to a review
    (less is better; persons without one have no value). Reviews of one's own work don't count. Ties in closeness go by name.
    Percentile: 100 x (beaten + half of the ties) / others, halves to even; no rank without a value or without others.
    """
    since = now - F.expr(f"INTERVAL {days} DAYS")
    order = Window.partitionBy("person").orderBy(F.desc("closeness"), "other")
    ring = near.where((F.col("closeness") > 0) & (F.col("other") != F.col("person"))).withColumn("i", F.row_number().over(order)).where(F.col("i") <= PEERS)
    ring = ring.select("person", F.col("other").alias("member"))
    circle = ring.union(ring.select("person", "person").distinct())
    done = outputs.where((F.col("at") >= since) & (F.col("at") <= now) & F.col("kind").isin("commit", "pr_merged", "pr_opened", "deployed"))
    seen = reviews.where((F.col("at") >= since) & (F.col("at") <= now) & ~F.col("person").eqNullSafe(F.col("author")))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    made = done.groupBy(F.col("person").alias("member"), "repo").agg(
        n("commit").alias("commits"), n("pr_merged").alias("prs_merged"), F.sum(F.when(F.col("kind") == "deployed", F.coalesce("n", F.lit(0))).otherwise(0)).alias("lines")
    )
    given = seen.groupBy(F.col("person").alias("member"), "repo").agg(F.count("*").alias("reviews"))
    work = made.join(given, ["member", "repo"], "full").fillna(0)
    shared = ring.join(work.select("member", "repo"), "member").select("person", "repo").distinct()
    where = circle.join(work, "member").join(shared, ["person", "repo"])
    counts = circle.join(where.groupBy("person", "member").agg(*[F.sum(c).alias(c) for c in ("prs_merged", "reviews", "commits", "lines")]), ["person", "member"], "left").fillna(0)
    long = counts.select("person", "member", F.explode(F.create_map(*[x for c in ("prs_merged", "reviews", "commits", "lines") for x in (F.lit(c), F.col(c).cast("double"))])).alias("item", "v"))
    # A reviewer's hours are ranked once a circle they are in: at most rows of reviews x circles of the reviewer.
    hours = seen.where(F.col("at") >= F.col("created")).select(F.col("person").alias("member"), "repo", ((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))) / 3.6e9).alias("v"))
    turn = middle(circle.join(hours, "member").join(shared, ["person", "repo"]), ["person", "member"], "v")
    long = long.unionByName(turn.select("person", "member", F.lit("turnaround").alias("item"), F.round("v", 1).alias("v")))
    own, w = F.col("member") == F.col("person"), Window.partitionBy("person", "item")
    long = long.withColumns({"mine": F.max(F.when(own, F.col("v"))).over(w), "sign": F.when(F.col("item") == "turnaround", -1).otherwise(1)})
    more = F.col("sign") * (F.col("v") - F.col("mine"))
    out = long.groupBy("person", "item").agg(
        F.first("mine").alias("mine"), F.count_if(~own).alias("others"), F.median(F.when(~own, F.col("v"))).alias("middle"),
        F.count_if(~own & (more > 0)).alias("above"), F.count_if(~own & (more == 0)).alias("same"), F.count_if(~own & (more < 0)).alias("beaten"),
    )
    ranked = F.col("mine").isNotNull() & (F.col("others") > 0)
    return out.select(
        "person", "item", "mine", "others", "middle", F.when(ranked, F.col("above") + 1).alias("place"),
        F.when(ranked, F.bround(100 * (F.col("beaten") + 0.5 * F.col("same")) / F.col("others"), 0).cast("long")).alias("percentile"),
    )


def _weekly(at: str, now: Column) -> list[Column]:
    """Six counts by week, oldest first."""
    back = insights.window_back(F.col(at), now)
    return [F.count_if(back == 5 - k).alias(f"w{k}") for k in range(6)]


def _judged(rows: DataFrame, now: Column) -> DataFrame:
    series = [F.col(f"w{k}") for k in range(6)]
    quiet = (F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 8.64e10
    return rows.withColumns({"series": F.array(*series), "status": insights.momentum(series, quiet, F.col("n_left")), "quiet_days": F.round(quiet, 1)}).drop(*[f"w{k}" for k in range(6)])


def momentum_cards(cards: DataFrame, activity: DataFrame, now: Column) -> DataFrame:
    """Cards that aren't over, with six weekly counts of activity, days since the last of it (or the update) and a status."""
    sums = activity.groupBy("card").agg(*_weekly("at", now), F.max("at").alias("last"))
    out = cards.where(~F.coalesce("state", F.lit("")).isin(*PAST)).join(sums, "card", "left").fillna(0, [f"w{k}" for k in range(6)])
    return _judged(out.withColumns({"n_left": F.coalesce("n_left", F.lit(0)), "last": F.coalesce("last", "updated")}), now)


def momentum_repos(cards: DataFrame, outputs: DataFrame, now: Column) -> DataFrame:
    """(person, repo) with commits or merges in the last six weeks: series, status, and what its open cards have left."""
    acts = outputs.where(F.col("kind").isin("commit", "pr_merged")).groupBy("person", "repo").agg(*_weekly("at", now), F.max("at").alias("last"))
    left = cards.where(~F.coalesce("state", F.lit("")).isin(*PAST)).groupBy("person", "repo").agg(F.sum("n_left").alias("n_left"))
    acts = acts.where(sum((F.col(f"w{k}") for k in range(6)), F.lit(0)) > 0)
    return _judged(acts.join(left, ["person", "repo"], "left").fillna(0, ["n_left"]), now)


def week(cards: DataFrame, now: Column) -> DataFrame:
    """A row a person: cards closed since Monday, by weekday, in the week before, in the best of four weeks; open ones; achievements."""
    start = F.date_trunc("week", now)
    at = F.col("updated").cast("timestamp")
    is_closed = F.col("state").isin(*CLOSED)
    back = F.when(at >= start, 0).otherwise(F.floor((F.unix_micros(start) - F.unix_micros(at)) / 6.048e11) + 1)
    rows = cards.withColumn("back", F.when(is_closed, back))
    n = lambda k: F.count_if(F.col("back") == k)
    out = rows.groupBy("person").agg(
        n(0).alias("closed"), n(1).alias("last_week"), F.greatest(n(0), n(1), n(2), n(3)).alias("best_week"),
        F.array(*[F.count_if((F.col("back") == 0) & (F.weekday("updated") == d)) for d in range(7)]).alias("per_day"),
        F.count_if(F.col("state").isin(*OPEN)).alias("n_open"),
    )
    days = F.size(F.filter("per_day", lambda x: x > 0)).cast("long")
    c, o = F.col("closed"), F.col("n_open")
    goals = {"first": (c, F.lit(1)), "closer": (c, F.lit(5)), "beat": (c, F.col("last_week") + 1), "daily": (days, F.lit(3)), "clean": (c, F.greatest(F.lit(1), c + o))}
    out = out.withColumns({f"goal_{k}": g.cast("long") for k, (_, g) in goals.items()} | {f"progress_{k}": F.least(h, g).cast("long") for k, (h, g) in goals.items()})
    return out.withColumns({f"has_{k}": (h >= g) if k != "clean" else (o == 0) & (c > 0) for k, (h, g) in goals.items()})


def closest(cards: DataFrame, top: int = 8) -> DataFrame:
    """The `top` open cards of each person that are nearest to done: fewest steps left, then newest; none known comes last."""
    left = F.coalesce("n_left", F.lit(0))
    order = Window.partitionBy("person").orderBy(left == 0, left, F.desc("updated"), "card")
    rows = cards.where(F.col("state").isin(*OPEN)).withColumn("place", F.row_number().over(order).cast("long"))
    return rows.where(F.col("place") <= top).select("person", "place", "card", "title", "updated", left.alias("n_left"))


def _long(rows: DataFrame, part: str, item: Column, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return rows.select("person", F.lit(part).alias("part"), item.cast("string").alias("item"), F.explode(pairs).alias("p")).select("person", "part", "item", "p.*")


def page(usage: DataFrame, outputs: DataFrame, reviews: DataFrame, near: DataFrame, cards: DataFrame, activity: DataFrame, now: Column, prices: dict, repos: list | None = None) -> DataFrame:
    """All the statistics, long: (person, part, item, name, value). `repos` keeps the outputs, reviews and cards of those alone.

    Usage has no repository of its own: a `repo` column of it is filtered too, if it has one.
    """
    if repos is not None:
        usage, outputs, reviews, cards = (t.where(F.col("repo").isin(*repos)) if "repo" in t.columns else t for t in (usage, outputs, reviews, cards))
    people = usage.select("person").union(outputs.select("person")).union(cards.select("person")).where("person IS NOT NULL").distinct()
    rows = game(token_windows(usage, people, now, prices), outputs, now)
    total, win, none = ["total", "price", "unpriced", "cache_share", "wtok"], F.col("win"), F.lit("")
    best, days = record(rows, outputs, now), week(cards, now)
    parts = [
        _long(rows, "tokens", win, total),
        _long(rows, "game", win, ["points", "score", "lines", "lines_per_m", "counts", *numbers.POINTS]),
        _long(token_models(usage, now, prices), "models", F.col("model"), ["total", "recent", "sessions", "price"]),
        _long(best, "record", none, [c for c in best.columns if c != "person"]),
        _long(kpis(rows), "kpi", F.col("item"), ["value", "base", "delta"]),
        _long(peers(near, outputs, reviews, now), "peers", F.col("item"), ["mine", "others", "middle", "place", "percentile"]),
        _long(days, "week", none, [c for c in days.columns if c not in ("person", "per_day")]),
        momentum_cards(cards, activity, now).groupBy("person", "status").agg(F.count("*").cast("double").alias("value")).select("person", F.lit("threads").alias("part"), F.col("status").alias("item"), F.lit("n").alias("name"), "value"),
        _long(momentum_repos(cards, outputs, now), "repos", F.concat_ws(" ", F.col("repo").cast("string"), "status"), ["quiet_days", "n_left"]),
        closest(cards).select("person", F.lit("closest").alias("part"), F.col("place").cast("string").alias("item"), F.col("card").cast("string").alias("name"), F.col("n_left").cast("double").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)
