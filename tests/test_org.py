"""The organisation against a plain version of its composition."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from loomfield.operators import org
from loomfield.plans import registry
from tests.test_rules import plain_role
from tests.test_teams import plain_likeness, plain_teams


def data():
    rng = random.Random(12)
    people = [(f"p{k:02d}", k) for k in range(22)]
    areas = [(p, f"r{k % 3}", f"r{k % 3}/a{rng.choice([k % 3, 7 + k % 3, rng.randrange(9)])}{n}", rng.randint(1, 25)) for p, k in people[:20] for n in range(4)]
    areas = [(*k, n) for k, n in Counter({(p, r, a): n for p, r, a, n in areas}).items()]
    channels = [(p, f"c{k % 3}", rng.randint(1, 9)) for p, k in people[:15]] + [(p, "all", 2) for p, _ in people[:12]]
    groups = [(p, f"g{k % 3}", k % 6 == 0) for p, k in people[:12]]
    approvals = [(a, b, n) for a, _ in people for b, n in ((people[rng.randrange(4)][0], 5), (rng.choice(people)[0], 2))]
    facts = [(p, rng.choice([0.0, 0.12, 0.3]), k % 4 == 0, datetime(2015 + k % 9, 1, 1) if k % 5 else None, k * 3, k % 7) for p, k in people[:20]]
    return people, areas, channels, groups, approvals, facts


def frames(spark, people, areas, channels, groups, approvals, facts):
    schemas = ("person string, place int", "member string, repo string, key string, n int", "member string, key string, n int", "member string, key string, maintains boolean", "author string, approver string, n int", "person string, blame double, owns boolean, first timestamp, prs int, reviews int")
    return [spark.createDataFrame(r, s) for r, s in zip((people, areas, channels, groups, approvals, facts), schemas, strict=True)]


def test_infer(spark):
    people, areas, channels, groups, approvals, facts = data()
    got = org.infer(*frames(spark, people, areas, channels, groups, approvals, facts), F.lit(datetime(2024, 1, 1)))
    sim = plain_likeness([(p, a, n) for p, _, a, n in areas], channels, [(p, g) for p, g, _ in groups])
    teams = plain_teams([p for p, _ in people], sim)
    of = {p: min(t, key=lambda q: int(q[1:])) for t in teams for p in t}
    rows = {r.person: r for r in got.people.collect()}
    assert {p: r.team for p, r in rows.items() if r.team} == of and len(rows) == len(people) and len(teams) >= 2
    named = {r.team: r for r in got.teams.collect()}
    for t in teams:
        r, inside = named[of[t[0]]], Counter(g for p, g, _ in groups if p in t)
        best = max(((n, -sum(1 for _, h, _ in groups if h == g), g) for g, n in inside.items() if n >= 2 and n * 2 >= len(t)), default=None)
        assert (r.listed, r.size, r.members) == (best[2] if best else None, len(t), sorted(t))
        if best:
            assert r.name == best[2]
        else:
            df, have = Counter(a for _, _, a, _ in areas), Counter(a for p, _, a, _ in areas if p in t)
            ranked = sorted((n < max(2, len(t) / 2), -n / df[a], -n, a) for a, n in have.items() if n >= 2)
            assert r.name == ranked[0][3] if ranked else r.name
        for p in t:
            near = sorted((sim.get((min(p, q), max(p, q)), 0) for q in t if q != p), reverse=True)[:3]
            near = [s for s in near if s]
            want = min(0.9, 0.3 + sum(near) / len(near) + (0.15 if best and (p, best[2]) in {(m, g) for m, g, _ in groups} else 0))
            assert abs(rows[p].team_confidence - want) < 0.011
    by_area, given = defaultdict(dict), defaultdict(Counter)
    for p, _, a, n in areas:
        by_area[a][p] = n
    for a, b, n in approvals:
        if a != b:
            given[a][b] += n
    known = {f[0]: f for f in facts}
    for p, _ in people:
        f, own = known.get(p, (p, 0, False, None, 0, 0)), [(r, n) for q, r, _, n in areas if q == p]
        top = [max(c.items(), key=lambda x: (x[1], [-ord(z) for z in x[0]])) for c in given.values() if sum(c.values()) >= 3.5 and max(c.values()) * 2 >= sum(c.values())]
        want = plain_role({
            "owned_areas": sum(1 for c in by_area.values() if len(c) >= 2 and max(c.values()) >= 10 and max(c.values()) >= 0.4 * sum(c.values()) and min(q for q in c if c[q] == max(c.values())) == p),
            "blame": f[1], "owns": f[2], "top_commits": max((n for _, n in own), default=0), "first": f[3], "repos": len({r for r, n in own if n >= 3}), "areas": sum(n >= 3 for _, n in own),
            "approved": sum(1 for c in given.values() if c[p]), "approver_for": sum(q == p for q, _ in top), "maintains": sum(m for q, _, m in groups if q == p), "prs": f[4], "reviews": f[5],
        })
        assert (rows[p].level, rows[p].depth, rows[p].breadth) == want[:3]


def test_no_people(spark):
    got = org.infer(*frames(spark, [], [], [], [], [], []), F.lit(datetime(2024, 1, 1)))
    assert got.people.collect() == got.teams.collect() == []


def test_query(spark):
    out = registry.QUERIES["q13_org"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.team for r in out}) > 1 and len({r.level for r in out}) > 1 and any(r.name != "Group" for r in out)
