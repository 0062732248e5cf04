"""Statistics against fixed expectations and a plain version of the peers."""

import datetime as dt
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomfield.operators import insights
from loomfield.operators import statistics as st

NOW = dt.datetime(2026, 10, 21, 12)  # a Wednesday
USAGE = "person string, session string, hour timestamp, model string, calls long, input long, output long, cache_write long, cache_read long, cache_write_1h long"
OUTPUTS = "person string, kind string, at timestamp, repo string, n long"
REVIEWS = "person string, author string, repo string, created timestamp, at timestamp"
CARDS = "person string, card string, state string, updated timestamp, title string, n_left long, repo string"
NEAR = "person string, other string, closeness double"
ACTIVITY = "card string, at timestamp"
PRICES = {"big": (4.0, 20.0, 0.2), "big-old": (15.0, 75.0, 1.5)}


def now():
    return F.lit(NOW).cast("timestamp")


def back(**kw):
    return NOW - dt.timedelta(**kw)


def people(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "person string")


def test_price_of_a_model(spark):
    m = 1_000_000
    rows = [("big-5", m, m, m, m, 0), ("us.anthropic.BIG-5", 0, 0, m, 0, m), ("big-old-1", m, 0, None, 0, 0), ("tiny", 10, 10, 0, 0, 0), (None, 1, 1, 1, 1, 1)]
    table = spark.createDataFrame([(i, *r[:1], 1, *r[1:]) for i, r in enumerate(rows)], "i int, model string, calls long, input long, output long, cache_write long, cache_read long, cache_write_1h long")
    got = [r.c for r in table.select("i", (st.cost(F.col("model"), PRICES).cast("double") / 1e12).alias("c")).orderBy("i").collect()]
    assert got == [29.2, 8.0, 15.0, None, None]


def test_windows_and_days_are_whole(spark):
    rows = [("ann", "s1", back(hours=5), "big", 1, 100, 10, 20, 80, 0), ("ann", "s2", back(days=8), "none", 2, 5, 5, 0, 0, 0), ("ann", "s3", back(days=100), "big", 1, 7, 0, 0, 0, 0), (None, "s4", back(days=1), "big", 1, 9, 9, 9, 9, 9)]
    usage = spark.createDataFrame(rows, USAGE)
    win = {(r.person, r.win): r for r in st.token_windows(usage, people(spark, "ann", "bob"), now(), PRICES).collect()}
    assert len(win) == 16 and all(win["bob", k].total == 0 and win["bob", k].cache_share is None for k in range(8))
    assert (win["ann", 0].total, win["ann", 0].cache_share, win["ann", 0].wtok) == (210, 0.4, 100 + 50 + 25 + 8)
    assert (win["ann", 1].unpriced, win["ann", 1].price) == (10, 0.0)
    days = {r.day: r.total for r in st.token_days(usage, people(spark, "ann"), now(), PRICES).collect()}
    assert len(days) == 56 and sum(days.values()) == 220 and days[NOW.date()] == 210
    models = {r.model: r for r in st.token_models(usage.where("person = 'ann'"), now(), PRICES).collect()}
    assert (models["big"].sessions, models["big"].total, models["big"].recent, models["none"].price) == (2, 217, 210, None)


def test_points_score_and_badges(spark):
    """66 points at 8.25 million weighted tokens are 800; commits stop at 30; lean needs fewer tokens a merge than before."""
    counts = {"pr_merged": 2, "thread_closed": 1, "ticket_done": 1, "review": 3, "commit": 40, "item_closed": 2}
    out = [("ann", k, back(hours=3), "r", None) for k, n in counts.items() for _ in range(n)] + [("ann", "deployed", back(hours=3), "r", 33)]
    out += [("bob", "thread_closed", back(hours=2), "r", None)] * 5 + [("bob", "pr_merged", back(hours=2), "r", None)] * 2
    merged = {1: 2, 2: 1, 4: 4}
    out += [("bob", "pr_merged", back(days=7 * k + 1), "r", None) for k, n in merged.items() for _ in range(n)]
    m = 1_000_000
    tok = [("ann", "s", back(hours=3), "big", 1, m, m, m, 10 * m, 0)] + [("bob", "s", back(days=7 * k, hours=3), "big", 1, n * m, 0, 0, 0, 0) for k, n in enumerate((30, 40, 30, 10, 40))]
    rows = st.game(st.token_windows(spark.createDataFrame(tok, USAGE), people(spark, "ann", "bob"), now(), PRICES), spark.createDataFrame(out, OUTPUTS), now()).cache()
    ann = rows.where("person = 'ann' AND win = 0").first()
    assert (ann.points, ann.wtok, ann.score, ann.lines, ann.lines_per_m) == (66, 8.25e6, 800, 33, 4.0)
    assert rows.where("person = 'ann' AND win = 3").first().score is None
    best = {r.person: r for r in st.record(rows, spark.createDataFrame(out, OUTPUTS), now()).collect()}
    bob = best["bob"]
    assert bob.has_closer and bob.has_lean and not bob.has_reviewer and bob.badge_reviewer == 0  # 15 million a merge, 20 before
    assert not best["ann"].has_lean and best["ann"].badge_reviewer == 3 and best["ann"].streak == 1
    assert (best["ann"].best_score, best["ann"].best_score_win, best["ann"].prev_score) == (800, 0, None)
    tiles = {(r.person, r.item): r for r in st.kpis(rows).collect()}
    assert (tiles["bob", "tokens"].value, tiles["bob", "tokens"].base) == (30e6, 35e6) and tiles["ann", "tokens"].delta is None
    assert tiles["bob", "per_commit"].value is None and tiles["bob", "per_thread"].value == 6e6


def test_a_window_with_few_tokens_is_no_record(spark):
    tok = [("ann", "s", back(days=7 * k, hours=3), "big", 1, n, 0, 0, 0, 0) for k, n in enumerate((8_000_000, 100, 8_000_000))]
    out = [("ann", "pr_merged", back(days=7 * k, hours=1), "r", None) for k in (0, 1, 1, 2)]
    rows = st.game(st.token_windows(spark.createDataFrame(tok, USAGE), people(spark, "ann"), now(), PRICES), spark.createDataFrame(out, OUTPUTS), now())
    got = st.record(rows, spark.createDataFrame(out, OUTPUTS), now()).first()
    assert {r.win: r.score for r in rows.collect()}[1] == 2000 and (got.best_score, got.best_score_win) == (125, 0)


@pytest.mark.parametrize("series, quiet, left, status", [
    ((0, 0, 2, 2, 2, 2), 0.5, 0, "momentum"), ((0, 0, 3, 2, 2, 2), 0.5, 3, "cooling"), ((9, 0, 0, 0, 0, 1), 1, 0, "cooling"), ((0, 0, 0, 1, 0, 0), 15, 2, "stalled"),
    ((0, 0, 0, 1, 0, 0), 15, 0, "quiet"), ((0, 0, 0, 0, 1, 0), 8, 1, "stalled"), ((0, 0, 0, 0, 1, 0), 8, 0, "cooling"), ((0,) * 6, 99, 0, "quiet"),
])
def test_status(spark, series, quiet, left, status):
    assert spark.range(1).select(insights.momentum([F.lit(x) for x in series], F.lit(quiet), F.lit(left)).alias("s")).first().s == status


def test_week(spark):
    monday = dt.datetime(2026, 10, 19, 9)
    day = dt.timedelta(days=1)
    rows = [
        ("a", "complete", monday, None), ("b", "complete", monday + day, None), ("c", "complete", monday - 3 * day, None), ("d", "open", back(minutes=1), 3),
        ("e", "open", back(minutes=1), 1), ("f", "open", back(minutes=1), None), ("g", "loose_ends", back(minutes=2), 1), ("h", "todo", back(minutes=1), 1), ("i", None, None, None),
    ]
    cards = spark.createDataFrame([("me", c, s, at, c.upper(), n, "r") for c, s, at, n in rows], CARDS)
    w = st.week(cards, now()).first()
    assert (w.closed, w.last_week, w.best_week, w.n_open, w.per_day) == (2, 1, 2, 4, [1, 1, 0, 0, 0, 0, 0])
    assert w.has_beat and w.has_first and not w.has_closer and not w.has_daily and not w.has_clean
    assert (w.goal_beat, w.goal_clean, w.progress_closer, w.progress_daily) == (2, 6, 2, 2)
    assert [r.card for r in st.closest(cards).orderBy("place").collect()] == ["e", "g", "d", "f"]


def test_momentum_of_cards_and_repos(spark):
    cards = spark.createDataFrame([("me", "a", "open", NOW, "A", 2, "r"), ("me", "b", "open", back(days=20), "B", None, "r"), ("me", "c", "closed", NOW, "C", 4, "r")], CARDS)
    acts = spark.createDataFrame([("a", back(days=k)) for k in (1, 2, 9)] + [("c", NOW), ("a", back(days=-1)), ("a", None)], ACTIVITY)
    got = {r.card: (r.series, r.status, r.quiet_days) for r in st.momentum_cards(cards, acts, now()).collect()}
    assert got == {"a": ([0, 0, 0, 0, 1, 2], "momentum", -1.0), "b": ([0] * 6, "quiet", 20.0)}
    out = spark.createDataFrame([("me", "commit", back(days=15), "r", None), ("me", "commit", back(days=90), "old", None), ("me", "review", NOW, "x", None)], OUTPUTS)
    assert [(r.repo, r.status, r.n_left) for r in st.momentum_repos(cards, out, now()).collect()] == [("r", "stalled", 2)]


def plain_peers(near, outputs, reviews):
    since, got = back(days=28), {}
    done = [o for o in outputs if o[2] and since <= o[2] <= NOW and o[1] in ("commit", "pr_merged", "pr_opened", "deployed")]
    seen = [r for r in reviews if since <= r[4] <= NOW and r[0] != r[1]]
    for me in {p for p, _, _ in near}:
        ring = [o for o, c in sorted(((o, c) for p, o, c in near if p == me and o != me and c > 0), key=lambda x: (-x[1], x[0]))][:10]
        shared = {o[3] for o in done if o[0] in ring} | {r[2] for r in seen if r[0] in ring}
        value, hours = defaultdict(Counter), defaultdict(list)
        for p, kind, _, repo, n in done:
            if repo in shared:
                value[p][{"commit": "commits", "pr_merged": "prs_merged", "deployed": "lines"}.get(kind, "")] += n if kind == "deployed" else 1
        for p, _, repo, created, at in seen:
            if repo in shared:
                value[p]["reviews"] += 1
                if at >= created:
                    hours[p].append((at - created).total_seconds() / 3600)
        for item in ("prs_merged", "reviews", "commits", "lines", "turnaround"):
            of = (lambda p: round(statistics.median(hours[p]), 1) if hours[p] else None) if item == "turnaround" else lambda p: value[p][item]
            mine, others = of(me), [of(p) for p in ring if of(p) is not None]
            if not ring or (mine is None and not others):
                continue
            sign, rank = (-1 if item == "turnaround" else 1), None
            if mine is not None and others:
                beaten, same = sum(sign * v < sign * mine for v in others), others.count(mine)
                rank = (1 + len(others) - beaten - same, round(100 * (beaten + 0.5 * same) / len(others)))
            got[me, item] = (mine, statistics.median(others) if others else None, rank)
    return got


@pytest.mark.parametrize("seed", range(2))
def test_peers_as_the_plain_version(spark, seed):
    rng = random.Random(seed)
    names = [f"p{k:02}" for k in range(16)]
    near = [(p, o, rng.choice((0.0, 0.1, 0.5, 0.5, 0.9))) for p in names[:6] for o in names if rng.random() < 0.85]
    outputs = [(rng.choice(names), rng.choice(("commit", "commit", "pr_merged", "deployed", "pr_opened", "ticket_done")), back(days=rng.randrange(40), hours=1), rng.choice("abc"), rng.randrange(50)) for _ in range(220)]
    reviews = []
    for _ in range(160):
        at = back(days=rng.randrange(35), minutes=rng.randrange(600))
        reviews.append((rng.choice(names), rng.choice(names), rng.choice("abcd"), at - dt.timedelta(minutes=rng.randrange(-60, 3000, 12)), at))
    frames = [spark.createDataFrame(*x) for x in ((near, NEAR), (outputs, OUTPUTS), (reviews, REVIEWS))]
    rows = st.peers(*frames, now()).collect()
    got = {(r.person, r.item): (r.mine, r.middle, None if r.place is None else (r.place, r.percentile)) for r in rows}
    want = plain_peers(near, outputs, reviews)
    assert got.keys() == want.keys()
    for key, (mine, mid, rank) in want.items():
        if key[1] == "turnaround":  # one decimal: halves may round either way
            assert [None if x is None else pytest.approx(x, abs=0.051) for x in (mine, mid)] == list(got[key][:2])
        else:
            assert got[key] == (mine, mid, rank)


def test_page_of_empty_and_of_chosen_repos(spark):
    empty = [spark.createDataFrame([], s) for s in (USAGE, OUTPUTS, REVIEWS, NEAR, CARDS, ACTIVITY)]
    assert st.page(*empty, now(), PRICES).count() == 0
    empty[1] = spark.createDataFrame([("me", "commit", back(days=1), r, None) for r in "aab"], OUTPUTS)
    empty[4] = spark.createDataFrame([("me", "x", "open", NOW, "X", 1, "a"), ("you", "y", "closed", NOW, "Y", 1, "b")], CARDS)
    whole, only = (st.page(*empty, now(), PRICES, r) for r in (None, ["a"]))
    commits = lambda page: {(r.person, r.value) for r in page.where("part = 'game' AND item = '0' AND name = 'commit'").collect()}
    assert commits(whole) == {("me", 3.0), ("you", 0.0)} and commits(only) == {("me", 2.0)}
    assert {(r.item, r.name) for r in only.where("part = 'closest'").collect()} == {("1", "x")}
