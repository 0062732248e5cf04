"""Identity resolution in rounds against the loop that goes through the edges one by one."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from loomfield.operators import identity
from loomfield.plans import registry


def plain(observations, candidates, work, split, merge, me):
    parent, facts = {}, defaultdict(set)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for _, keys in observations:
        for k in keys:
            parent.setdefault(k, k)
    work_mail = lambda k: k.startswith("email:") and k in work and k not in split and not k.endswith("@gmail.com")
    for k in parent:
        facts[k] = {x for x, yes in (("split", k in split), ("slack", k.startswith("slack:") and k not in split), (k.split("@")[-1], work_mail(k))) if yes}

    def bars(a, b):
        x, y = facts[root(a)], facts[root(b)]
        return "split" in x | y or bool((x & y) - {"split"})

    def join(a, b):
        x, y = sorted((root(a), root(b)))
        if x != y:
            parent[y] = x
            facts[x] |= facts[y]

    strong = {o: [k for k in keys if not k.startswith("name:") and k not in split] for o, keys in observations}
    for o, _ in observations:
        for k in strong[o][1:]:
            join(strong[o][0], k)
    refused = set()
    turns = [(strong[o][0], k) for o, keys in observations for k in keys if k.startswith("name:") and k not in split and strong[o]]
    best = {}
    for a, b, s in candidates:
        if a in parent and b in parent and a != b:
            best[min(a, b), max(a, b)] = max(s, best.get((min(a, b), max(a, b)), 0))
    turns += [p for p, s in sorted(best.items(), key=lambda x: (-x[1], x[0])) if s >= identity.JOIN]
    for a, b in turns:
        if root(a) != root(b):
            if bars(a, b):
                refused.add((a, b))
            else:
                join(a, b)
    mine = sorted(k for k in me if k in parent and k not in split)
    for a, b in [*merge, *[(mine[0], k) for k in mine[1:]]]:
        if a in parent and b in parent:
            join(a, b)
    groups = defaultdict(list)
    for k in parent:
        groups[root(k)].append(k)
    maybe = {p for p, s in best.items() if identity.MAYBE <= s < identity.JOIN and root(p[0]) != root(p[1]) and not bars(*p)}
    return {k: min(g) for g in groups.values() for k in g}, refused, maybe


def frames(spark, observations, candidates, work, split, merge, me):
    one = lambda values: spark.createDataFrame([(v,) for v in values], "key string")
    return (
        spark.createDataFrame(observations, "obs long, keys array<string>"), spark.createDataFrame(candidates, "a string, b string, score double"),
        one(work), one(split), spark.createDataFrame(merge, "a string, b string"), one(me),
    )


@pytest.mark.parametrize("seed", [1])
def test_same_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    hosts = ["acme.io", "gmail.com", "corp.dev"]
    pool = [f"{k}:{'u' if k != 'name' else 'Name '}{n}{'@' + hosts[n % 3] if k == 'email' else ''}" for n in range(25) for k in ("email", "gh", "slack", "name")]
    observations = [(o, rng.sample(pool, rng.randint(1, 3))) for o in range(35)] + [(35, []), (36, ["name:only"])]
    candidates = [(*rng.sample(pool, 2), rng.choice([0.5, 0.6, 0.7, 0.8, 0.8, 0.9, 0.95])) for _ in range(120)]
    data = (observations, candidates, set(rng.sample(pool, 60)), set(rng.sample(pool, 4)), [tuple(rng.sample(pool, 2)) for _ in range(3)], rng.sample(pool, 3))
    got = identity.resolve(*frames(spark, *data))
    people, refused, maybe = plain(*data)
    assert {r.key: r.person for r in got.people.collect()} == people
    assert {(r.a, r.b) for r in got.rejected.collect()} == refused and len(refused) > 3
    assert {(r.a, r.b) for r in got.maybe.collect()} == maybe


def test_vetoes_and_overrides(spark):
    observations = [(1, ["email:ann@acme.io", "gh:ann", "name:ann lee"]), (2, ["email:al@acme.io", "gh:al", "name:ann lee"]), (3, ["slack:1", "name:bo"]), (4, ["slack:2", "name:bo"]), (5, ["gh:cy"]), (6, ["gh:dee"])]
    candidates = [("gh:cy", "gh:dee", 0.95), ("gh:cy", "slack:1", 0.9), ("gh:dee", "slack:2", 0.85)]
    data = (observations, candidates, {"email:ann@acme.io", "email:al@acme.io"}, set(), [("slack:2", "gh:al")], [])
    got = identity.resolve(*frames(spark, *data))
    person = {r.key: r.person for r in got.people.collect()}
    assert person["name:ann lee"] == person["gh:ann"] != person["gh:al"]  # two work mails
    assert person["slack:1"] == person["gh:cy"] == person["gh:dee"] != person["slack:2"]  # two accounts
    assert person["slack:2"] == person["gh:al"]  # the user said so
    assert {r.why for r in got.rejected.collect()} == {"two different work mails with commits at one domain", "two different chat accounts"}
    assert person == plain(*data)[0]


def test_a_name_that_many_have_takes_no_round_for_each(spark, monkeypatch):
    """Connected edges are settled in a task; rounds, which large parts still take, give the same."""
    observations = [(o, [f"gh:{o}", *([f"slack:{o}"] if o % 5 == 0 else []), f"name:n{o % 2}"]) for o in range(40)]
    data = (observations, [(f"gh:{o}", f"gh:{o + 1}", 0.9) for o in range(0, 40, 7)], set(), {"gh:3"}, [], [])
    rounds = []
    real = identity.merge_best_first
    monkeypatch.setattr(identity, "merge_best_first", lambda *a: rounds.append(1) or real(*a))
    got = identity.resolve(*frames(spark, *data))
    assert {r.key: r.person for r in got.people.collect()} == plain(*data)[0] and not rounds
    assert {(r.a, r.b) for r in got.rejected.collect()} == plain(*data)[1]
    few = ([o for o in observations if o[0] < 8], data[1], set(), {"gh:3"}, [], [])
    monkeypatch.setattr(identity, "SMALL", 1)
    got = identity.resolve(*frames(spark, *few))
    assert {r.key: r.person for r in got.people.collect()} == plain(*few)[0] and rounds


def test_empty_tables(spark):
    got = identity.resolve(*frames(spark, [], [], [], [], [], []))
    assert got.people.collect() == got.joins.collect() == got.rejected.collect() == got.maybe.collect() == []


def test_query_has_joins_and_vetoes(spark):
    out = registry.QUERIES["r02_resolve"](spark, "/root/testdata/sf0.001").collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r.person] += 1
    assert len(out) > 300 and max(sizes.values()) > 3 and any(r.refused for r in out)
