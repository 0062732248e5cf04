"""Branches, areas, shell calls, names, definitions and the choice of k against plain versions."""

from __future__ import annotations

import ast
import random
import re
from collections import Counter, defaultdict
from datetime import datetime
from itertools import islice

from pyspark.sql import functions as F

from loomfield.operators import areas, branches, cluster, definitions, names, shell
from loomfield.plans import q_code, registry

DAY = lambda n: datetime(2024, 1, n)


def test_branch_states(spark):
    lines = {
        "a1": [("f", 1, "x = 1"), ("f", 1, "y = 2")], "a2": [("f", -1, "y = 2"), ("g", 1, "z")], "squash": [("g", 1, "z  "), ("f", 1, "x =  1")],
        "b1": [("f", 1, "b")], "b2": [("f", 1, "bb")], "rb1": [("f", 1, "b")], "rb2": [("f", 1, " bb")], "d1": [("f", 1, "d")], "d2": [("f", 1, "dd")], "sd": [("f", 1, "d")],
        "e1": [("f", 1, "e")], "old": [("f", 1, "e")], "other": [("f", 1, "x = 1"), ("h", 1, "z")], "none": [("f", 1, None), ("f", -1, "")],
    }
    changes = [("r", sha, *c) for sha, cs in lines.items() for c in cs]
    commits = [("r", b, n, sha, DAY(n + 9)) for b, shas in {"a": ["a1", "a2"], "b": ["b1", "b2"], "c": ["k1"], "d": ["d1", "d2"], "e": ["e1"], "n": ["none"]}.items() for n, sha in enumerate(shas)]
    base = [("r", sha, DAY(20)) for sha in ("squash", "rb1", "rb2", "sd", "k1", "other")] + [("r", "old", DAY(1)), ("r2", "e1", DAY(20))]
    got = branches.branch_states(
        spark.createDataFrame(commits, "repo string, branch string, seq int, sha string, at timestamp"),
        spark.createDataFrame(changes, "repo string, sha string, path string, sign int, line string"), spark.createDataFrame(base, "repo string, sha string, at timestamp"),
    )
    assert {r.branch: (r.state, r.squashed_at, r.commits) for r in got.collect()} == {
        "a": ("squashed", 2, 2), "b": ("rebased", None, 2), "c": ("merged", None, 1), "d": ("partly", 1, 2), "e": ("open", None, 1), "n": ("open", None, 1),
    }
    held = spark.createDataFrame([("r", "b")], "repo string, branch string")
    verdict = {r.branch: (r.idle_days, r.verdict) for r in branches.branch_verdicts(got, held, F.lit(DAY(30))).collect()}
    assert verdict == {"a": (20, "review"), "b": (20, "keep"), "c": (21, "remove"), "d": (20, "keep"), "e": (21, "keep"), "n": (21, "keep")}


def test_worktrees(spark):
    rows = [("/w/a", True, False, DAY(1), 0, 0, True), ("/w/b", True, False, DAY(1), 2, 1, False), ("/w/c", False, False, None, 0, 0, True), ("/w/d", True, True, DAY(1), 0, 2, True), ("/w/e", True, False, DAY(1), 0, 2, True), ("/w/ab", True, False, DAY(1), 0, 0, True)]
    trees = spark.createDataFrame(rows, "path string, here boolean, locked boolean, last_commit timestamp, uncommitted int, ahead int, pushed boolean")
    sessions = spark.createDataFrame([("/w/ab/src/x", DAY(29)), ("/w/a", DAY(5)), (None, DAY(30))], "cwd string, updated timestamp")
    got = {r.path: (r.idle_days, r.verdict, r.why) for r in branches.worktree_verdicts(trees, sessions, F.lit(DAY(30))).collect()}
    assert got == {
        "/w/a": (25, "remove", "clean, in the default branch"), "/w/b": (29, "review", "uncommitted changes, commits not merged or pushed"), "/w/c": (None, "remove", "its folder is gone"),
        "/w/d": (29, "review", "locked"), "/w/e": (29, "remove", "clean, pushed"), "/w/ab": (1, "keep", "in use"),
    }


def plain_areas(paths, share, least):
    """Each folder's longest start, of four levels at most, of which every shorter start holds more than the limit."""
    folders = [tuple(p.split("/")[:-1]) for p in paths]
    held = Counter(f[:n] for f in folders for n in range(1, len(f) + 1))
    limit = max(least, share * len(paths))
    out = []
    for f in folders:
        n = min(1, len(f))
        while n < min(4, len(f)) and held[f[:n]] > limit:
            n += 1
        out.append("/".join(f[:n]) or ".")
    return out


def test_adaptive_areas(spark):
    rng = random.Random(5)
    paths = ["/".join([*(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6]))), f"f{k}"]) for k in range(400)]
    rows = [("r", p, 1) for p in paths] + [("q", p, 1) for p in paths[:60]] + [(None, "x/y", 1), ("r", "src//f", 1)]
    out = areas.adaptive_areas(spark.createDataFrame(rows, "repo string, path string, folder int"), least=10)
    got = defaultdict(dict)
    for r in out.collect():
        got[r.repo][r.path] = r.area
    for repo, some in (("r", [*paths, "src//f"]), ("q", paths[:60])):
        assert [got[repo][p] for p in some] == plain_areas(some, 0.06, 10)
    assert len({*got["r"].values()}) > 8 and out.count() == len(rows)
    assert areas.adaptive_areas(spark.createDataFrame([], "repo string, path string")).collect() == []


PUSH, BARE, NEW, OLD, COMMIT = (re.compile(p) for p in (shell.PUSH, shell.PUSH_BARE, shell.CHECKOUT_NEW, shell.CHECKOUT, shell.COMMIT))


def plain_code(command):
    """The command token by token."""
    tokens = re.findall(shell.TOKENS, re.sub(shell.HEREDOC, "\n", command or ""))
    return "".join('""' if t[0] in "\"'" and len(t) > 1 and re.search(r"\b(?:git|gh) ", t) else t for t in tokens)


def test_quoted_text():
    assert plain_code("echo \"git a\" git push \"x\"") == 'echo "" git push "x"' and plain_code("sh -c 'git x'") == "sh -c 'git x'"
    assert plain_code("cat <<E\ngit push\nE\nls") == "cat \nls"


def plain_edges(calls, origins):
    """One session after another, one call after another."""
    out, state = [], defaultdict(lambda: ["", ""])
    for session, seq, command, result, cwd, recorded in sorted(calls, key=lambda c: (c[0], c[1])):
        code = plain_code(command)
        result = result or ""
        folder, branch = state[session]
        folder = cwd or folder
        repo = origins.get(folder, "")
        key = lambda b: f"{repo}@{b}" if repo else b  # noqa: E731, B023
        found = [("branch", key(b), f"created {b}") for b in NEW.findall(code) if b not in shell.GENERIC]
        moved = NEW.findall(code) or OLD.findall(code)
        branch = moved[-1] if moved else branch
        on = branch or recorded
        found += [("branch", key(b), f"git push {b}") for b in PUSH.findall(code) if b not in shell.GENERIC]
        if on and on not in shell.GENERIC and "error" not in result.lower()[:200]:
            found += [("branch", key(on), f"git push {on}")] if BARE.search(code) and not PUSH.search(code) else []
            found += [("branch", key(on), "git commit")] if COMMIT.search(code) else []
        url = re.search(r"https://github\.com/([\w.-]+/[\w.-]+)/pull/(\d+)", result)
        found += [("pr", f"{url[1]}#{url[2]}", "gh pr create")] if url and re.search(r"\bgh pr create\b", code) else []
        flag = re.search(r"(?:-R|--repo)\s+([\w.-]+/[\w.-]+)", code)
        target = flag[1] if flag else repo
        found += [("pr", f"{target}#{n}", "gh pr merge") for n in re.findall(r"\bgh pr merge\s+(\d+)", code) if target]
        out += [(session, seq, *f) for f in found]
        cd = re.search(r"\bcd\s+(\S+)", code)
        state[session] = [folder or (cd[1] if cd else ""), branch]
    return sorted(out)


COMMANDS = [
    "cd /w/a && git checkout -b feat/x", "git push", "git push -u origin HEAD", "git push origin HEAD:other", "git -C /z commit -m 'git push origin no' && git push", "git checkout main", "git switch dev;",
    "gh pr create --title \"gh pr merge 9\"", "gh pr merge 12 --repo o/r; gh pr merge 13", "gh pr merge 4", "cat <<'EOF'\ngit push origin doc\nEOF\ngit commit -am x", "bash -c \"git push origin real\"",
    "echo \"a\" git push origin mid \"b\"", "git switch -c y && git checkout z", "cd /w/b", None, "echo 'it' \"git commit", "git checkout -- file.txt",
]


def test_shell_edges_as_one_by_one(spark):
    rng = random.Random(8)
    results = ["ok", None, "Error: denied", "see https://github.com/o/r.x/pull/7 and https://github.com/o/p/pull/8", "x" * 300 + "error"]
    calls = [(s, n, rng.choice(COMMANDS), rng.choice(results), rng.choice([None, None, "", "/w/a", "/w/c"]), rng.choice([None, "", "rec"])) for s in range(40) for n in range(rng.randint(0, 12))]
    origins = {"/w/a": "acme/a", "/w/b": "acme/b"}
    schema = "session int, seq int, command string, result string, cwd string, branch string"
    got = shell.shell_edges(spark.createDataFrame(calls, schema), spark.createDataFrame([*origins.items()], "folder string, repo string")).collect()
    assert sorted((r.session, r.seq, r.kind, r.key, r.evidence) for r in got) == plain_edges(calls, origins)
    fixture, repos = q_code.shell_calls(spark, "/root/testdata/sf0.001")
    rows, known = [tuple(r) for r in fixture.select("session", "seq", "command", "result", "cwd", "branch").collect()], {r.folder: r.repo for r in repos.collect()}
    own = registry.QUERIES["g07_shell_edges"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.session, r.seq, r.kind, r.key, r.evidence) for r in own) == plain_edges(rows, known) and len(own) > 20


def test_mentions(spark):
    links = spark.createDataFrame([(1, "pr", "a#1"), (1, "pr", "a#1"), (1, "url", "http://x"), (2, "ticket", "AB-1")], "session int, kind string, key string")
    assert sorted(tuple(r) for r in shell.mentions(links).collect()) == [(1, "pr", "a#1"), (2, "ticket", "AB-1")]


def plain_readings(word, known, prefix):
    """All ways to go on from a place, lazily."""

    def ways(i):
        for j in range(i + 2, len(word) - 1):
            if word[i:j] in known:
                if prefix or word[j:] in known:
                    yield f"{word[i:j]} {word[j:]}"
                yield from (f"{word[i:j]} {rest}" for rest in ways(j))

    return set(islice(ways(0), 8))


def test_joined_names(spark):
    rng = random.Random(4)
    vocabulary = ["text", "area", "te", "xt", "ar", "ea", "aa", "aaa", "user", "id", "us", "er", "idle", "a"]
    values = ["textarea", "TEXTAREA", "TextArea", "text_area", "userid", "userids", "abc", None, "", "a" * 32, "a" * 33, "a" * 12 + "b"] + ["".join(rng.choices(vocabulary, k=4)) for _ in range(20)]
    frame, words = spark.createDataFrame([(v, 1) for v in [*values, "userid"]], "name string, word int"), spark.createDataFrame([(w,) for w in vocabulary], "word string")
    for prefix in (False, True):
        got = defaultdict(set)
        for r in names.joined_names(frame, words, prefix=prefix).collect():
            assert r.reading not in got[r.name]
            got[r.name].add(r.reading)
        fit = {v for v in values if v and 4 <= len(v) <= 32 and v.isalnum() and (v.islower() or v.isupper())}
        assert got == {v: s for v in fit if (s := plain_readings(v.lower(), set(vocabulary), prefix))}
        assert "text area" in got["TEXTAREA"]


def test_fragments(spark):
    often = {"order": 5, "not": 90, "found": 80, "in": 99, "cache": 20, "writing": 7, "workers": 3, "to": 99, "jdoe": 1}
    messages = [(1, "order_id[20879] not found in cache"), (2, "Writing workers to jdoe"), (3, None), (4, "cache zzqy not found")]
    frame = spark.createDataFrame([(w, n) for w, n in often.items()], "word string, df int")
    got = {r.id: (r.fragments, r.holes) for r in names.fragments(spark.createDataFrame(messages, "id int, text string"), frame).collect()}
    assert got[1][0][0] == "] not found in cache" and got[1][1] and "not found in cache" in got[1][0]
    assert got[2] == (["Writing workers to", "workers to jdoe", "Writing workers"], False) and got[3] == ([], False)
    assert got[4][1] and "not found" in got[4][0]


def plain_enclosing(source, line):
    kinds = ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef
    spans = [(min(x.lineno for x in (d, *d.decorator_list)), d.end_lineno, d.name) for d in ast.walk(ast.parse(source)) if isinstance(d, kinds)]
    start, end, name = max((s for s in spans if s[0] <= line <= s[1]), default=(0, 0, None))
    return (name, start, end) if name else None


def test_enclosing_and_excerpts(spark):
    source = "import x\n\n@d\nclass A:\n    y = 1\n\n    @e\n    async def f(self):\n        def g():\n            pass\n        return '''\nclass no:\n'''\n\nif x:\n    def h(): pass\nz = 1\ndef long():\n" + "    pass\n" * 250
    files = spark.createDataFrame([("a.py", source), ("b.py", "def broken(:"), ("c.txt", source), ("d.py", None)], "path string, text string")
    found = definitions.definitions(files)
    n = source.count("\n")
    hits = spark.createDataFrame([(p, k) for p in ("a.py", "b.py", "c.txt", "d.py") for k in range(0, n + 3)] + [("a.py", 5)], "path string, line int")
    out = definitions.enclosing(hits, found)
    got = {r.line: (r.name, r.start, r.end) for r in out.collect()}
    assert got == {k: e for k in range(n + 3) if (e := plain_enclosing(source, k))} and {r.path for r in out.collect()} == {"a.py"}
    texts = {r.line: r for r in definitions.excerpts(out, files).collect()}
    lines = source.split("\n")
    assert texts[9].text == "\n".join(lines[8:10]) and not texts[9].truncated
    head, far = texts[20], texts[200]
    assert head.truncated and head.text.split("\n") == lines[17:217]
    assert far.text.split("\n")[:10] == lines[17:27] and far.text.split("\n")[10] == "    … lines 28-99 …" and far.text.split("\n")[11:] == lines[99:268]
    own = registry.QUERIES["j10_enclosing"](spark, "/root/testdata/sf0.001").collect()
    held = {r.path: r.text for r in q_code.code_files(spark, "/root/testdata/sf0.001").collect()}
    assert len(own) > 100 and all(plain_enclosing(held[r.path], r.line) == (r.name, r.start, r.end) for r in own[::7])


def test_siblings(spark):
    paths = ["a/x.py", "a/readme.md", "a/tests/t.py", "a/lib/u.py", "a/.hidden", "a/__init__.py", "top.py", *(f"m/f{k}.py" for k in range(12))]
    got = {r.path: r.beside for r in definitions.siblings(spark.createDataFrame([(p,) for p in [*paths, "top.py"]], "path string")).collect()}
    assert got["a/x.py"] == ["tests/", "readme.md", "lib/"] and got["a/.hidden"] == ["tests/", "readme.md", "lib/", "x.py"] == got["a/__init__.py"]
    assert got["top.py"] == ["a/", "m/"] and got["m/f3.py"] == ["f0.py", "f1.py", "f10.py", "f11.py", "f2.py", "f4.py", "f5.py", "f6.py", "+3 more"]


def test_choice_of_k(spark):
    rng = random.Random(2)
    centres = [[1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1]]
    rows = [(k, [c + rng.gauss(0, 0.03) for c in centres[k % 5 if k < 60 else 0]]) for k in range(80)]
    out = cluster.choose_clusters(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v")
    got = {r.id: r.cluster for r in out.collect()}
    assert len({*got.values()}) == 5 and {got[k] for k in range(60, 80)} == {0} and all(got[k] == got[k % 5] for k in range(60))
    few = cluster.choose_clusters(spark.createDataFrame(rows[:7], "id int, v array<double>"), "id", "v")
    assert {r.cluster for r in few.collect()} == {0}


def test_branch_states_query_without_lines_and_with_equal_contents(spark, tmp_path):
    """Orders without lines, and branches whose orders have the same lines, are told apart as the query's SQL does."""
    import duckdb

    orders = [(10 * b + k, b, datetime(2001, 1, 1 + k)) for b in (1, 2, 3, 4, 8, 10) for k in range(3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(10 * b + k, 7 + k, n, 5) for b in (1, 2, 3, 8) for k in range(1, 3) for n in (1, 2)]  # the first order of each has none, 4 and 10 have none at all
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = db.sql(registry.ORACLES["x37_branch_states"]).df()
    got = registry.QUERIES["x37_branch_states"](spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, got[want.columns].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_fragments_are_sent_on_in_small_parts(spark, monkeypatch):
    """Fragments grow with the square of a message's words, so those of many messages are never held at once; the rows are the same."""
    words = [f"word{chr(97 + k % 26)}" for k in range(40)]
    messages = spark.createDataFrame([(k, " ".join(words[: k % 40]) + f" {k}") for k in range(60)] + [(60, None)], "id long, text string").coalesce(1)
    often = spark.createDataFrame([(w, 3) for w in set(words)] + [("word", 5)], "word string, df long")
    whole = {r.id: (r.fragments, r.holes) for r in names.fragments(messages, often).collect()}
    monkeypatch.setattr(names, "SENT", 1)
    parts = {r.id: (r.fragments, r.holes) for r in names.fragments(messages, often).collect()}
    assert parts == whole and len(parts) == 61 and whole[39][0] and whole[60] == ([], False)
