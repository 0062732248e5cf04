"""Joins of near and alike rows against all pairs."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from loomfield.operators import linkage, search, vectors


def test_band_pairs(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["u", "u", "v", None]), rng.choice([None, *range(-40, 60)])) for k in range(150)]
    got = linkage.band_pairs(spark.createDataFrame(rows, "i int, k string, t int"), "i", "k", "t", 7)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 7}
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)


def test_alike_sets(spark):
    rng = random.Random(2)
    rows = [(k, rng.sample("abcdefghij", rng.randint(0, 6)) + ["all"] * (k % 3 > 0)) for k in range(80)] + [(80, None)]
    frame = spark.createDataFrame(rows, "i int, ws array<string>")
    for share in (0.5, 0.75, 1.0):
        want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len({*x} & {*y}) >= share * len({*x} | {*y})}
        assert sorted((r.a, r.b) for r in linkage.alike_sets(frame, "i", "ws", share).collect()) == sorted(want)


def test_z_scores_of_groups(spark):
    rows = [("a", 1.0), ("a", 3.0), (None, 5.0), (None, 5.0), ("b", None)]
    got = search.z(spark.createDataFrame(rows, "g string, x double"), "x", "g").select("g", F.round("z", 6).alias("z")).collect()
    assert sorted(((r.g or "", r.z) for r in got), key=str) == [("", 0.0), ("", 0.0), ("a", -1.0), ("a", 1.0), ("b", None)]


def test_best_of_blocks_of_vectors(spark, monkeypatch):
    """The best by products of blocks are those of all pairs, copies and ties included, and no pair is a row before."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = random.Random(5)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for k in range(100)]
    frame = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    best = search.similar(frame, frame.where("id % 10 = 0"), "id", "v", 5)
    dots = {q: sorted((-sum(x * y for x, y in zip(u, v)), k) for k, v in rows if k != q) for q, u in rows if q % 10 == 0}
    want = {(q, k, -s, r) for q, near in dots.items() for r, (s, k) in enumerate(near[:5], 1)}
    assert {(r.query, r.id, r.sim, r["rank"]) for r in best.collect()} == want
    some = vectors.block_products(frame, frame.where("id % 10 = 0"), "id", "v", k=5)
    assert some.count() <= 10 * 5 * (100 // 16 + 6)
    assert "NestedLoop" in best._jdf.queryExecution().executedPlan().toString() and vectors.block_products(frame, frame, "id", "v", but_self=False).count() == 100 * 100


def test_coworkers_of_tasks_with_the_same_folders(spark):
    """Counts are those of all pairs of a task and a commit, but commits are counted once for tasks with the same folders."""
    from datetime import datetime

    from loomfield.operators import work

    rng = random.Random(6)
    touched = [(t, t if t < 25 else rng.randint(0, 9), f"f{rng.randint(0, 2)}") for t in range(30) for _ in range(3)]
    commits = [(s, rng.randint(0, 30), datetime(2024, 1, rng.randint(1, 28)), f"f{rng.randint(0, 2)}/x") for s in range(60)]
    got = work.coworkers(spark.createDataFrame(touched, "task long, me long, folder string"), spark.createDataFrame(commits, "sha long, author long, at timestamp, path string"), F.to_timestamp(F.lit("2024-01-28")))
    pairs = {(t, a, s, at) for t, me, f in touched for s, a, at, path in commits if path.startswith(f) and a != me and at >= datetime(2024, 1, 7)}
    want = {(t, a): (len({p[2] for p in pairs if p[:2] == (t, a)}), max(p[3] for p in pairs if p[:2] == (t, a))) for t, a, *_ in pairs}
    assert {(r.task, r.author): (r.commits, r["last"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(folder" in plan


def test_coworkers_leave_as_many_tasks_as_there_are_cores(spark):
    """The rows of the join are many more than what is shuffled, so its tasks are not merged by how little they read."""
    from datetime import datetime

    from loomfield.operators import work

    touched = [(t, t, f"f{t % 2}") for t in range(40)]
    commits = [(a * 100 + k, a, datetime(2024, 1, 20 + k), f"f{a % 2}/x") for a in range(40) for k in range(a % 3)]
    got = work.coworkers(spark.createDataFrame(touched, "task long, me long, folder string"), spark.createDataFrame(commits, "sha long, author long, at timestamp, path string"), F.to_timestamp(F.lit("2024-01-28")))
    want = {(t, a): (a % 3, datetime(2024, 1, 19 + a % 3)) for t in range(40) for a in range(t % 2, 40, 2) if a != t and a % 3}
    assert {(r.task, r.author): (r.commits, r["last"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert f", {8 * spark.sparkContext.defaultParallelism})" in plan and "REPARTITION_BY_NUM" in plan


def test_related_pairs_by_files_only_where_sinks_are_few(spark):
    from loomfield.operators import work

    rng = random.Random(8)
    sinks = {(rng.randint(0, 19), f"s{rng.randint(0, 9)}") for _ in range(30)}
    files = {(rng.randint(0, 24), f"f{rng.randint(0, 9)}") for _ in range(60)}
    n = lambda rows, a, b: len({k for c, k in rows if c == a} & {k for c, k in rows if c == b})
    want = set()
    for a in range(25):
        near = [(0, -n(sinks, a, b), b, "sink") if n(sinks, a, b) else (1, -n(files, a, b), b, "files") for b in range(25) if a != b and (n(sinks, a, b) or n(files, a, b))]
        want |= {(a, b, why) for _, _, b, why in sorted(near)[:5]}
    got = work.related(spark.createDataFrame(list(sinks), "card long, sink string"), spark.createDataFrame(list(files), "card long, file string"))
    assert {(r.a, r.b, r.reason) for r in got.collect()} == want
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()


def few_and_many(seed):
    """Sets of a few keys, some sharing one, some two or more; two sets of very many keys; one key that nobody else has."""
    rng = random.Random(seed)
    rows = {(s, rng.randrange(30)) for s in range(40) for _ in range(rng.randrange(5))}
    rows |= {(100, k) for k in range(25)} | {(101, k) for k in range(3, 40)} | {(102, 999)}
    held = {}
    for s, f in rows:
        held.setdefault(s, set()).add(f)
    return sorted(rows), held


def test_shared_twice_and_kin(spark):
    """Pairs that share one key alone are in no join of pairs; counts are those of all pairs."""
    rows, held = few_and_many(2)
    frame = spark.createDataFrame([*rows, rows[0], (None, 1), (5, None)], "s long, f long")
    both = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b}
    got = {(r.a, r.b): r.n for r in linkage.shared_twice(spark.createDataFrame(rows, "s long, f long")).collect()}
    assert got == {p: n for p, n in both.items() if n > 1}
    kin = {a: sum(bool(held[a] & held[b]) for b in held if b != a) for a in held}
    assert {r.s: r.kin for r in linkage.kin_counts(frame).collect()} == {a: n for a, n in kin.items() if n}


def test_file_kin_by_one_and_more_files(spark):
    rows, held = few_and_many(3)
    df = {f: sum(f in h for h in held.values()) for _, f in rows}
    w = {f: math.log((len(held) + 1) / (n + 1)) for f, n in df.items()}
    t = {s: sum(w[f] for f in h) for s, h in held.items()}
    want = {}
    for a in held:
        for b in held:
            both = sum(w[f] for f in held[a] & held[b] if df[f] <= 9)
            if a < b and both and round(both / (t[a] + t[b] - both), 6) >= 0.1:
                want[a, b] = both / (t[a] + t[b] - both)
    got = {(r.a, r.b): r.sim for r in linkage.file_kin(spark.createDataFrame(rows, "s long, f long"), "s", "f", 0.1, 9).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) > 9


def test_file_kin_of_files_that_very_many_have(spark):
    """No file is left out by how many have it; pairs are those of a loop, with large sessions, nulls and sessions of common files alone."""
    rng = random.Random(9)
    rows = {(s, f) for s in range(90) for f in ["all"] * (s != 7) + ["most"] * (s % 8 > 0) + [f"f{rng.randrange(40)}" for _ in range(rng.choice([0, 0, 1, 2, 3, 30]))]}
    edits = [*sorted(rows), (None, "f1"), (None, "most"), (3, None)]
    held, df = {}, {}
    for s, f in rows:
        held.setdefault(s, set()).add(f)
    for _, f in edits:
        df[f] = df.get(f, 0) + 1
    w = {f: math.log((len(held) + 1) / (n + 1)) for f, n in df.items() if f}
    t = {s: sum(w[f] for f in fs) for s, fs in held.items()}
    frame = spark.createDataFrame([*edits, edits[0]], "s long, f string")
    for least in (0.1, 0.25, 0.6):
        both = {(a, b): sum(w[f] for f in held[a] & held[b]) for a in held for b in held if a < b and held[a] & held[b]}
        want = {(a, b): c / (t[a] + t[b] - c) for (a, b), c in both.items() if round(c / (t[a] + t[b] - c), 6) >= least}
        got = {(r.a, r.b): r.sim for r in linkage.file_kin(frame, "s", "f", least).collect()}
        assert got.keys() == want.keys() and len(want) > 200
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    same = spark.createDataFrame([(1, "x"), (2, "x")], "s long, f string")
    assert [(r.a, r.b, math.isnan(r.sim)) for r in linkage.file_kin(same, "s", "f").collect()] == [(1, 2, True)]


def test_set_similarity_and_parts(spark):
    """Tasks grow with the pairs, not with the session's number of partitions."""
    rows, held = few_and_many(4)
    got = {(r.a, r.b): r.sim for r in linkage.set_similarity(spark.createDataFrame([*rows, rows[0]], "a long, k long")).collect()}
    want = {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a in held for b in held if a < b and held[a] & held[b]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    pairs = spark.createDataFrame([(9_000_000,), (90_000_000,)], "n long")
    assert linkage.parts_for(pairs) == 100 and linkage.parts_for(pairs.where("n < 0")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_members_go_once_to_each_stretch(spark):
    """What a key has is sent once to each stretch of items that has it, however many items are there; many stretches give the same pairs."""
    rows, held = few_and_many(6)
    own = spark.createDataFrame([(a, k) for k in range(5) for a in range(10 * k, 10 * k + 10)] + [(3, 9), (33, 9), (47, 9)], "a long, k long")
    names = spark.createDataFrame([(a, a // 20) for a in range(50)], "a long, stretch int")
    got = sorted((r.stretch, r.m, list(r.all)) for r in linkage.in_stretches(own, names).collect())
    assert got == sorted([(k // 2, 10, list(range(10 * k, 10 * k + 10))) for k in range(5)] + [(0, 1, [3, 33, 47]), (1, 1, [33, 47])])
    want = {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a in held for b in held if a < b and held[a] & held[b]}
    sims = linkage.set_similarity(spark.createDataFrame(rows, "a long, k long"), each=20).collect()
    assert {(r.a, r.b): round(r.sim, 9) for r in sims} == {p: round(s, 9) for p, s in want.items()} and len(sims) == len(want)


def test_copies_are_one_set_until_the_end(spark):
    """Items with the same members, in any order, give all their pairs, but one set is compared with others."""
    sets = [["a", "b"], ["b", "a"], ["a", "b", "c"], ["c", "b", "a"], ["x", "y"], ["a", "b"], []]
    got = linkage.alike_sets(spark.createDataFrame(list(enumerate(sets)), "i int, ws array<string>"), "i", "ws", 0.6)
    want = [(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x and y and len({*x} & {*y}) >= 0.6 * len({*x} | {*y})]
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)
