"""Teams and average linkage against loops over one member or pair at a time."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from loomfield.operators import agglomerate, likeness_blocks, teams
from loomfield.plans import registry


def plain_teams(members, sim, bar=0.3, big=15):
    """Labels move one at a time; a large team is taken apart by the same rule with a higher bar."""

    def nearest(a):
        others = [(round(sim.get((min(a, b), max(a, b)), 0) * teams.UNIT), b) for b in members if b != a]
        return [x for x in sorted(others)[::-1][:6] if x[0] >= bar * teams.UNIT]

    near, label = {a: nearest(a) for a in members}, dict(zip(members, members, strict=True))

    def move(a):
        votes = defaultdict(int)
        for weight, b in near[a]:
            votes[label[b]] += weight
        first = max(votes, key=lambda x: (votes[x], x), default=label[a])
        moves = first != label[a] and votes[first] > votes[label[a]]
        label[a] = first if moves else label[a]
        return moves

    sweeps = iter(range(15))
    while next(sweeps, None) is not None and any([move(a) for a in members]):
        pass
    found = []
    for name in dict.fromkeys(label.values()):
        team = [m for m in members if label[m] == name]
        found += plain_teams(team, sim, bar + 0.15, big) if len(team) > big and bar < 0.7 else [team] * (len(team) > 1)
    return found


def graph(seed, n, blocks, inner, noise):
    rng = random.Random(seed)
    members = [f"m{k:03d}" for k in range(n)]
    rng.shuffle(members)
    block = {m: k % blocks for k, m in enumerate(members)}
    sim = {}
    for i, a in enumerate(members):
        for b in members[i + 1 :]:
            s = rng.uniform(*inner) if block[a] == block[b] else rng.uniform(0, noise)
            if s > 0.2:
                sim[min(a, b), max(a, b)] = round(s, 6)
    return members, sim


@pytest.mark.parametrize(
    ("n", "blocks", "inner", "noise", "big", "small"), [(24, 4, (0.4, 0.9), 0.35, 15, 9999), (40, 2, (0.3, 0.95), 0.45, 8, 9999), (30, 30, (0, 1), 0.8, 15, 9999), (14, 2, (0.4, 0.9), 0.5, 15, 0)]
)
def test_teams_as_one_by_one(spark, n, blocks, inner, noise, big, small):
    members, sim = graph(n, n, blocks, inner, noise)
    got = teams.teams(
        spark.createDataFrame([(m, k) for k, m in enumerate(members)], "member string, place int"),
        spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "a string, b string, sim double"), big=big, small=small,
    )
    held = defaultdict(set)
    for r in got.collect():
        held[r.team].add(r.member)
    assert sorted(map(sorted, held.values())) == sorted(map(sorted, plain_teams(members, sim, big=big)))
    assert all(min(g, key=members.index) == t for t, g in held.items())


def test_no_members(spark):
    empty = teams.teams(spark.createDataFrame([], "member string, place int"), spark.createDataFrame([], "a string, b string, sim double"))
    assert empty.collect() == []


def plain_likeness(areas, channels, groups):
    n = len({m for rows in (areas, channels, groups) for m, *_ in rows})

    def vectors(rows):
        df, out = Counter(k for _, k, _ in rows), defaultdict(dict)
        for m, k, c in rows:
            out[m][k] = math.log1p(c) * math.log(1 + n / df[k])
        return out

    cos = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    parts, of = [vectors(areas), vectors(channels)], defaultdict(set)
    for m, k in groups:
        of[m].add(k)
    out = {}
    names = sorted({m for rows in (areas, channels, groups) for m, *_ in rows})
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            have = [(w, cos(p[a], p[b])) for w, p in zip((0.6, 0.25), parts, strict=True) if a in p and b in p]
            have += [(0.15, len(of[a] & of[b]) / len(of[a] | of[b]))] if of[a] and of[b] else []
            if any(s for _, s in have):
                out[a, b] = sum(w * s for w, s in have) / sum(w for w, _ in have)
    return out


def test_likeness(spark):
    rng = random.Random(3)
    areas = [(f"m{m}", f"a{k}", rng.randint(1, 9)) for m in range(9) for k in rng.sample(range(8), 3) if m != 4]
    channels = [(f"m{m}", f"a{k}", rng.randint(1, 9)) for m in range(6) for k in rng.sample(range(5), 2)]
    groups = [(f"m{m}", f"g{m % 3}") for m in range(2, 8)]
    got = teams.work_likeness(*(spark.createDataFrame(r, f"member string, key string{', n int' if len(r[0]) == 3 else ''}") for r in (areas, channels, groups)))
    want = plain_likeness(areas, channels, groups)
    have = {(r.a, r.b): r.sim for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)


def plain_linkage(pairs, goal, forced):
    sim = {frozenset((a, b)): s for a, b, s in pairs}
    clusters = [{x} for x in sorted({x for a, b, *_ in [*pairs, *forced] for x in (a, b)})]

    def merge(x, y):
        clusters.remove(x)
        clusters.remove(y)
        clusters.append(x | y)

    for a, b in forced:
        x, y = (next(c for c in clusters if v in c) for v in (a, b))
        if x is not y:
            merge(x, y)
    while len(clusters) > 1:
        best = max(((sum(sim.get(frozenset((a, b)), 0) for a in x for b in y) / len(x) / len(y), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters[:i])))
        if best[0] < goal:
            break
        merge(clusters[best[1]], clusters[best[2]])
    return sorted(map(sorted, clusters))


@pytest.mark.parametrize("goal", [0.25, 0.6])
def test_average_linkage_as_one_by_one(spark, goal):
    rng = random.Random(7)
    names = [f"i{k:02d}" for k in range(40)]
    pairs = [(a, b, round(rng.uniform(0.5, 1) if i % 5 == j % 5 else rng.uniform(0, 0.6), 7)) for i, a in enumerate(names) for j, b in enumerate(names[:i]) if rng.random() < 0.7]
    forced = [("i01", "i02"), ("i02", "i08"), ("x", "y")]
    got = agglomerate.average_linkage(spark.createDataFrame(pairs, "a string, b string, sim double"), goal, spark.createDataFrame(forced, "a string, b string"))
    held = defaultdict(set)
    for r in got.collect():
        held[r.cluster].add(r.item)
    assert sorted(map(sorted, held.values())) == plain_linkage(pairs, goal, forced) and all(min(g) == c for c, g in held.items())


def test_queries_find_groups(spark):
    for name, key in (("r05_teams", "team"), ("x51_average_linkage", "cluster")):
        sizes = Counter(r[key] for r in registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect())
        assert max(sizes.values()) > 1 and len(sizes) > 1


def test_likeness_block_by_block(spark, monkeypatch):
    """Many blocks and sides give the pairs and teams of one loop, whatever size a task may have."""
    for module in (teams, likeness_blocks):
        monkeypatch.setattr(module, "SIDE", 4)
        monkeypatch.setattr(module, "BLOCK", 10)
    monkeypatch.setattr(likeness_blocks, "KEYS", 2)
    monkeypatch.setattr(likeness_blocks, "PAIRS", 8)
    rng = random.Random(5)
    names = [f"m{k:02d}" for k in range(36)]
    rng.shuffle(names)
    areas = [(m, f"a{k % 4}-{rng.randrange(3)}", rng.randint(1, 9)) for k, m in enumerate(names) if k % 9] + [(m, "all", 1) for m in names[:30]]
    channels = [(m, f"c{k // 5}", rng.randint(1, 9)) for k, m in enumerate(names[:33])]
    groups = [(m, f"g{k % 3}") for k, m in enumerate(names[:12])]
    like = teams.likeness(*(spark.createDataFrame(r, f"member string, key string{', n int' if len(r[0]) == 3 else ''}") for r in (areas, channels, groups)))
    want, have = plain_likeness(areas, channels, groups), {(r.a, r.b): r.sim for r in like.pairs().collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)
    members = spark.createDataFrame([(m, k) for k, m in enumerate(names)], "member string, place int")
    for big, small in ((6, 9999), (6, 30)):
        held = defaultdict(set)
        for r in teams.teams(members, like, big=big, small=small).collect():
            held[r.team].add(r.member)
        assert sorted(map(sorted, held.values())) == sorted(map(sorted, plain_teams(names, want, big=big)))


def test_pairs_of_blocks_in_order(spark, monkeypatch):
    """A task gives the pairs of two blocks in order, though it compares them side by side, and blocks are stretches of names."""
    import pandas as pd

    for module in (teams, likeness_blocks):
        monkeypatch.setattr(module, "SIDE", 3)
        monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(likeness_blocks, "ROWS", 2)
    rows = [("all", 0, 1, k // 10, f"m{k:02d}", 0, k % 3, 1.0 + k / 100) for k in range(20)] + [("all", 0, 1, k // 10, f"m{k:02d}", 0, 9, 0.5) for k in range(20)]
    frame = pd.DataFrame(rows, columns=["grp", "lo", "hi", "block", "member", "part", "key", "w"])
    got = pd.concat(list(likeness_blocks.all_pairs(iter([frame]), 3)))
    pairs = list(zip(got["a"], got["b"], strict=True))
    assert pairs == [(f"m{i:02d}", f"m{j:02d}") for i in range(10) for j in range(10, 20)] and got["sim"].map(lambda s: s == round(s, 3)).all()
    areas = spark.createDataFrame([(k, f"a{k % 4}", 1) for k in range(40)], "member long, key string, n int")
    none = areas.where("false")
    like = teams.work_likeness(areas, none, none.select("member", "key"), 6)
    assert sorted((r.a, r.b, r.sim) for r in like.collect()) == [(i, j, 1.0) for i in range(40) for j in range(i + 4, 40, 4)]
