"""Projects against hand-worked expectations, and their grouping against a plain version."""

import datetime as dt
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomfield.operators import projects as pj

NOW = dt.datetime(2026, 5, 1)
SCHEMAS = {
    "tickets": "key string, title string, state string, updated timestamp, parent string, linear string, component string", "links": "a string, b string", "assignees": "key string, person string",
    "pulls": "url string, repo string, title string, head string, body string, state string, author string, milestone string, updated timestamp", "reviewers": "url string, person string",
    "branches": "ref string, name string, author string, updated timestamp", "commits": "ref string, author string, subject string, at timestamp",
    "card_keys": "card string, key string, updated timestamp", "card_pulls": "card string, url string", "closeness": "person string, closeness double",
}


def ago(days):
    return NOW - dt.timedelta(days=days)


def frames(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}


def model(spark, **rows):
    return pj.build(**frames(spark, **rows), me="me", now=F.lit(NOW).cast("timestamp"))


def pull(url, title="", head="", body="", state="open", author=None, milestone=None, days=1, repo="site"):
    return (url, repo, title, head, body, state, author, milestone, ago(days))


def ticket(key, title=None, state="todo", days=1, parent=None, linear=None, component=None):
    return (key, title or key, state, ago(days), parent, linear, component)


@pytest.mark.parametrize("title, prefix", [("[On-call] Disk full", "on-call"), ("Billing: retry", "billing"), ("http://x", ""), ("plain", ""), (None, ""), ("A:b c", ""), ("  Pay & co: x", "pay & co")])
def test_prefix(spark, title, prefix):
    assert spark.createDataFrame([(title,)], "t string").select(pj.prefix_of(F.col("t")).alias("p")).first().p == prefix


def test_ties_and_states(spark):
    got = model(
        spark,
        tickets=[ticket("AB-1"), ticket("AB-2"), ticket("AB-3"), ticket("AB-4", state="done"), ticket("AB-5", days=200), ticket("AB-6", days=200), ticket("AB-7", state="close"), (None,) * 7],
        pulls=[
            pull("u1", "AB-1 start", state="merged"), pull("u2", "x", "AB-2-fix", state="review"), pull("u3", "AB-4", state="draft"), pull("u4", body="AB-1 AB-2 AB-3 AB-7", state="open"),
            pull("u5", "CVE-2024 and AB-9", body="AB-3", state="draft"), pull("old", "AB-6", days=130),
        ],
        branches=[("site@AB-7", "AB-7", "ann", ago(2)), ("site@AB-5", "AB-5", "ann", ago(3))],
        commits=[("site@c1", "ann", "AB-8: tidy", ago(1)), ("site@c2", "me", "AB-10: tidy", ago(1)), ("site@c3", None, None, None)],
        card_keys=[("c", "AB-2", ago(1)), ("c", None, ago(1))], card_pulls=[("c", "u1"), ("c", None)],
    )
    ties = {tuple(r) for r in got.ties.select("ticket", "kind", "ref").collect()}
    assert {("AB-1", "pr_title", "u1"), ("AB-2", "pr_branch", "u2"), ("AB-3", "pr_body", "u5"), ("AB-2", "card", "u1"), ("AB-2", "card", "c"), ("AB-9", "pr_title", "u5")} <= ties
    assert not any(t == "CVE-2024" or r in ("u4", "old") for t, _, r in ties)  # no such prefix; a list of keys; too old
    state = {r.ticket: r.state for r in got.tickets.collect()}
    # AB-6 is too old, AB-8 is only in a commit of somebody else
    assert state == {"AB-1": "done", "AB-2": "close", "AB-3": "progress", "AB-4": "done", "AB-5": "progress", "AB-7": "close", "AB-9": "progress", "AB-10": "todo"}


def test_scores_members_and_loose_pull_requests(spark):
    got = model(
        spark,
        tickets=[ticket("AB-1", "One", days=10, parent="AB-9"), ticket("AB-2", "Two", days=30, parent="AB-9"), ticket("CD-1", "Other", days=0)],
        assignees=[("AB-1", "me"), ("AB-2", "ann"), ("CD-1", "bob"), ("CD-1", "cat"), ("CD-1", "dan"), ("CD-1", "eve"), ("CD-1", None)],
        pulls=[pull("u1", "AB-2", state="merged", author="ann", days=30), pull("u2", "mine", author="me", days=10), pull("u3", "near", author="bob"), pull("u4", "far", author="zed"), pull("u5", "read", author="zed", repo="api", days=0)],
        reviewers=[("u1", "me"), ("u1", "ann"), ("u5", "me")], closeness=[("ann", 0.5), ("bob", 0.9), ("cat", 0.6), ("dan", 0.3), ("eve", 0.1)],
    )
    p = {(r.kind, r.project): r for r in got.projects.collect()}
    assert set(p) == {("parent", "AB-9"), ("ticket", "CD-1"), ("pr", "site:mine"), ("pr", "site:team"), ("pr", "api:mine")}
    a = p["parent", "AB-9"]
    assert (a.section, a.involvement, a.score, a.people, a.tickets, a.prs_merged, a.done) == ("mine", 0.75, 0.425, 1, 2, 1, 1)  # (3 + 1.5) / 6; half after ten days
    assert a.likely_done and not a.stale  # its one pull request is merged and nothing is in work
    other = p["ticket", "CD-1"]
    assert (other.section, other.closeness, other.score, other.people) == ("around", 0.6, 0.75, 4)
    assert (p["pr", "site:mine"].score, p["pr", "api:mine"].involvement, p["pr", "site:team"].closeness) == (0.5, 0.5, 0.9) and not p["pr", "site:team"].likely_done
    members = {(r.project, r.person): r.roles for r in got.members.collect()}
    assert members["AB-9", "ann"] == ["assignee", "author"] and members["AB-9", "me"] == ["assignee", "reviewer"] and members["api:mine", "me"] == ["reviewer"]


def test_empty_tables(spark):
    got = model(spark)
    assert got.ties.count() == got.tickets.count() == got.members.count() == got.projects.count() == 0


def plain_groups(tickets, tied, miles, links):
    """The rules one ticket at a time: tickets by key, tied (ticket, kind, ref), milestone by address."""
    match = lambda t: re.match(r"^\s*(?:\[([^\]]{2,40})\]|([A-Za-z][\w .&/-]{1,30}):\s)", t)
    pre = {k: ((m := match(t[1])) and (m[1] or m[2]).strip().lower()) or "" for k, t in tickets.items()}
    most = lambda c: min(c, key=lambda g: (-c[g], g))
    parents, own = {t[4] for t in tickets.values() if t[4]}, {}
    for k, t in tickets.items():
        c = Counter(miles[r] for r in {r for x, _, r in tied if x == k} if miles.get(r))
        own[k] = ("parent", t[4]) if t[4] else ("parent", k) if k in parents else ("linear", t[5]) if t[5] else ("component", f"{k.split('-')[0]}/{t[6]}") if t[6] else ("milestone", most(c)) if c else None
    placed, major = {k: g for k, g in own.items() if g}, defaultdict(dict)
    for g, size in Counter(placed.values()).items():
        for p, n in Counter(pre[k] for k in placed if placed[k] == g and pre[k]).items():
            if 2 * n > size:
                major[p][g] = n
    out = dict(placed)
    at = {(x, r) for x, kind, r in tied if kind != "commit"}
    for k in tickets:
        if k not in placed:
            near = Counter(placed[o] for x, kind, r in tied if x == k and kind != "commit" for o, r2 in at if r2 == r and o in placed)
            if pre[k] in major or near:
                out[k] = most(major[pre[k]]) if pre[k] in major else most(near)
    rest = {k for k in tickets if k not in out}
    nodes = defaultdict(set)
    for k in rest:
        for name in [f"p{pre[k]}"] * bool(pre[k] and sum(pre[o] == pre[k] for o in rest) <= 60) + [f"r{r}" for x, r in at if x == k]:
            nodes[name].add(k)
    sets = [set(v) for v in nodes.values()] + [{a, b} for a, b in links if {a, b} <= rest] + [{k} for k in rest]
    merged = []
    for s in sets:
        touch = [m for m in merged if m & s]
        merged = [m for m in merged if not m & s] + [s.union(*touch)]
    for s in merged:
        first = min(s, key=lambda x: (x.split("-")[0], int(x.split("-")[1])))
        out |= {k: ("linked" if len(s) > 1 else "ticket", first) for k in s}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_groups_as_the_plain_version(spark, seed):
    rng = random.Random(seed)
    some = lambda p, *xs: rng.choice(xs) if rng.random() < p else None
    keys = [f"{s}-{n}" for s in ("AB", "CD") for n in range(1, 41)]
    heads = ("Billing: ", "[ops] ", "Web: ", "Docs: ", "Lone: ", "", "", "")
    tickets = {k: ticket(k, rng.choice(heads) + f"work {k}", parent=some(0.15, "AB-1", "CD-2", "ZZ-9"), linear=some(0.1, "L1", "L2"), component=some(0.1, "core")) for k in keys}
    miles = {f"u{i}": some(0.3, "v1", "v2") for i in range(30)}
    tied = {(rng.choice(keys), rng.choice(("pr_title", "pr_body", "commit")), f"u{rng.randrange(30)}") for _ in range(45)} | {(rng.choice(keys), "card", f"c{i}") for i in range(15) for _ in range(2)}
    links = [(rng.choice(keys), rng.choice(keys)) for _ in range(12)]
    rows = spark.createDataFrame(list(tickets.values()), SCHEMAS["tickets"]).withColumnRenamed("key", "ticket")
    pulls = spark.createDataFrame([pull(u, milestone=m) for u, m in miles.items()], SCHEMAS["pulls"])
    got = pj.groups(rows, spark.createDataFrame(sorted(tied), "ticket string, kind string, ref string"), pulls, spark.createDataFrame(links, SCHEMAS["links"]))
    want = plain_groups(tickets, tied, miles, links)
    assert {r.ticket: (r.kind, r.project) for r in got.collect()} == want
    assert {"parent", "linear", "component", "milestone", "linked", "ticket"} <= {k for k, _ in want.values()}
