"""Tasks against a plain version that goes through sessions and items one by one."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from loomfield.operators import tasks
from loomfield.plans import registry

KEY, BRANCH_KEY = re.compile(r"\b[A-Z][A-Z0-9]{1,9}-\d{1,6}\b"), re.compile(r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9]{1,9}[-_]\d{1,6})(?![0-9])")


def plain(sessions, said, edits, commits, items):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    project = lambda k: k.rsplit("-", 1)[0]
    known = {i[1] for i in items if i[1]}
    prefixes = {project(k) for k in known} | {project(k) for s in sessions for k in KEY.findall(s[2] or "")}
    keys_in = lambda t: [k for k in dict.fromkeys(KEY.findall(t or "")) if project(k) in prefixes]
    in_branch = lambda b: [k for k in dict.fromkeys(x.upper().replace("_", "-") for x in BRANCH_KEY.findall(b or "")) if k in known]
    by_branch = defaultdict(list)
    for s in sessions:
        if s[1] and s[2] and s[2] not in tasks.DEFAULT_BRANCHES:
            by_branch[s[1], s[2]].append(s)
    short = {k for k, v in by_branch.items() if len(v) <= 6 and max(x[5] for x in v) - min(x[4] if x[4] is not None else x[5] for x in v) <= 4 * 86400}
    for k in short:
        for s in by_branch[k]:
            join(f"s:{s[0]}", f"b:{k[0]}@{k[1]}")
        for key in in_branch(k[1]):
            join(f"b:{k[0]}@{k[1]}", f"t:{key}")
    home, near = defaultdict(set), defaultdict(set)
    strong = {s[0]: set(keys_in(s[3]) + in_branch(s[2])) for s in sessions}
    for s in sessions:
        for key in strong[s[0]]:
            home[key] |= {s[1]} if s[1] else set()
    for repo, sha, _, subject, _ in commits:
        for key in keys_in(subject):
            home[key].add(repo)
            join(f"c:{sha}", f"t:{key}")
    for key, repos in home.items():
        near[project(key)] |= repos
    for s in sessions:
        found = Counter()
        for i, key, n in said:
            if i == s[0] and project(key) in prefixes:
                found[key] += n
        homes = lambda k: home.get(k) or near.get(project(k))
        weak = [k for k in found if s[1] and (not homes(k) or s[1] in homes(k))] if not strong[s[0]] else []
        pick = strong[s[0]] or ({min(weak, key=lambda k: (-found[k], k))} if weak and len(found) <= 3 else set())
        for key in pick:
            join(f"s:{s[0]}", f"t:{key}")
        find(f"s:{s[0]}")
    edited = defaultdict(set)
    for i, p in edits:
        edited[i].add(p)
    n_edits = Counter(p for s in sessions for p in edited[s[0]])
    words = {s[0]: set(re.findall(r"[a-z0-9][a-z0-9.+#-]*", (s[3] or "").lower())) - set(tasks.STOP) for s in sessions}
    for a in sessions:
        for b in sessions:
            if a[0] < b[0] and abs(a[5] - b[5]) <= 3 * 86400:
                shared = [p for p in edited[a[0]] & edited[b[0]] if n_edits[p] <= 3]
                x, y = words[a[0]], words[b[0]]
                files = a[1] and a[1] == b[1] and (len(shared) >= 2 or any(n_edits[p] == 2 for p in shared))
                topic = len(x) >= 2 and len(y) >= 2 and len(x & y) * 2 >= len(x | y) and (not a[1] or not b[1] or a[1] == b[1])
                if files or topic:
                    join(f"s:{a[0]}", f"s:{b[0]}")
    for i, key, branch, _, text, *_ in items:
        for k in short:
            if branch and k[1] == branch:
                join(f"i:{i}", f"b:{k[0]}@{k[1]}")
        for t in [key] if key else keys_in(text)[:3]:
            join(f"i:{i}", f"t:{t}")
        find(f"i:{i}")
    groups = defaultdict(set)
    for n in parent:
        groups[find(n)].add(n)
    of, mine_c = {str(i[0]): i for i in items}, {c[1]: c[4] for c in commits}
    out = []
    for g in groups.values():
        its = [of[n[2:]] for n in g if n[0] == "i"]
        keyed = [i for i in its if i[1]]
        some, brs = any(n[0] == "s" for n in g), any(n[0] == "b" for n in g)
        if not some and not keyed and not any(i[6] for i in its):
            continue
        if not some and not brs and keyed and not any(i[7] for i in its) and not any(mine_c[n[2:]] for n in g if n[0] == "c"):
            continue
        out.append(sorted(g))
    return sorted(out)


SCHEMAS = (
    "id int, repo string, branch string, title string, started long, updated long", "id int, key string, n int", "id int, path string", "repo string, sha string, at long, subject string, mine boolean",
    "id int, key string, branch string, title string, text string, at long, pr boolean, mine boolean",
)


def test_groups_as_one_by_one(spark):
    rng = random.Random(21)
    key = lambda: f"{rng.choice(['AB', 'CD', 'ZZ'])}-{rng.randrange(12)}"
    words = ["fix", "login", "page", "the", "cache", "flaky", "test", "deploy", "c++", "docs", "token", "retry", *(f"w{k}" for k in range(40))]
    branches = ["main", "", None, "feat/ab-3", "CD-4_more", "long", *(f"b{k}" for k in range(25))]
    sessions = [(k, rng.choice(["/r1", "/r2", "", None]), rng.choice(branches), " ".join(rng.sample(words, rng.randint(0, 5))) + (f" {key()}" if rng.random() < 0.1 else ""), rng.choice([None, 10_000 * k]), 10_000 * k + 500) for k in range(70)]
    said = [(rng.randrange(70), key(), rng.randint(1, 3)) for _ in range(40)]
    edits = [(rng.randrange(70), f"f{rng.randrange(60)}") for _ in range(110)]
    commits = [("/r1", f"c{k}", 1000 * k, rng.choice(["", f"{key()} done", "no key"]), k % 4 == 0) for k in range(20)]
    items = [(k, key() if k % 3 == 0 and k < 30 else None, rng.choice([None, "b1", "b2", "main"]), f"item {k}", rng.choice([None, f"{key()} {key()} {key()} {key()}", "plain"]), k, k % 5 == 0, k % 6 == 0) for k in range(36)]
    items = [(i, k if not k or k[0] != "Z" else "AB-1", *r) for i, k, *r in items]
    data = (sessions, said, edits, commits, items)
    got = tasks.group_work(*(spark.createDataFrame(r, s) for r, s in zip(data, SCHEMAS, strict=True)))
    held = defaultdict(list)
    for r in got.members.collect():
        held[r.task].append(r.node)
    want = plain(*data)
    assert sorted(map(sorted, held.values())) == want and len(want) > 5
    cards = {r.task: r for r in got.cards.collect()}
    assert cards.keys() == held.keys() and all(cards[t].sessions == sum(n[0] == "s" for n in g) and cards[t].commits == sum(n[0] == "c" for n in g) for t, g in held.items())
    assert all(c.title is not None for c in cards.values())


def test_empty_tables(spark):
    got = tasks.group_work(*(spark.createDataFrame([], s) for s in SCHEMAS))
    assert got.members.collect() == got.cards.collect() == []


def test_query(spark):
    out = registry.QUERIES["q14_tasks"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) > 20 and max(r.sessions for r in out) > 1 and any(r.tickets and r.branches and r.commits for r in out)


def test_topic_links_tie_the_same_sessions(spark):
    """The components of all pairs, from few links: sessions with the same words are tied once each, however many are near."""
    rng = random.Random(8)
    words = ["fix", "login", "page", "cache", "flaky", "test", "deploy", *(f"w{k}" for k in range(6))]
    some = [(k, rng.choice(["/r1", "/r2", None]), " ".join(rng.sample(words, rng.randint(0, 4))), rng.randrange(40 * tasks.DAY)) for k in range(160)]
    many = [(1000 + k, "/r1", "fix the login page", 100 * tasks.DAY + 60 * k) for k in range(60)] + [(1100 + k, "/r1", "login page", 103 * tasks.DAY + 60 * k) for k in range(40)] + [(1200, "/r1", "login page", None)]
    sessions = spark.createDataFrame(some + many, "id long, repo string, title string, at long").cache()
    links = [tuple(r) for r in tasks.topic_links(sessions).collect()]
    pairs = [tuple(r) for r in tasks.same_topic(sessions).collect()]

    def parts(edges):
        root = {k: k for k, *_ in some + many}
        for _ in root:
            low = [(x, min(root[a], root[b])) for a, b in edges for x in (a, b)]
            if all(root[x] <= m for x, m in low):
                return root
            for x, m in low:
                root[x] = min(root[x], m)
        return root

    assert parts(links) == parts(pairs) and len(set(parts(pairs).values())) > 5
    assert sum(a >= 1000 for a, _ in links) < 110 < 1000 < sum(a >= 1000 for a, _ in pairs)
