"""Chunks of long lines, roles and bots against plain versions."""

from __future__ import annotations

import math
import random
from datetime import datetime

from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.operators import chunk, ownership


def plain_chunks(text, size, cap=0):
    """Lines are dealt into groups, groups into pieces."""
    groups, length = [[]], 0
    for n, line in enumerate(text.split("\n"), 1):
        groups[-1].append((n, line))
        length += len(line) + 1
        if length >= size or (length > size * 2 // 5 and not line.strip()):
            groups.append([])
            length = 0
    pieces = []
    for group in filter(None, groups):
        body = "\n".join(line for _, line in group)
        cuts = [size * k for k in range(1 + max(0, math.ceil(len(body) / size) - 2))]
        pieces += [(group[0][0], group[-1][0], body[a:b]) for a, b in zip(cuts, [*cuts[1:], len(body)], strict=True)]
    pieces = [p for p in pieces if p[2].strip()]
    return pieces[: cap or None]


def test_long_lines_are_cut(spark):
    rng = random.Random(6)
    texts = ["", "one", "x" * 199, "é" * 1000, "a b\n\n" * 60, "y" * 250 + "\n" + "z" * 201 + "\nend", " " * 500 + "\n" + "w" * 700]
    texts += ["\n".join("word " * rng.choice([0, 1, 3, 30, 90]) for _ in range(rng.randint(1, 12))) for _ in range(25)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size, cap in ((100, 0), (100, 3), (1500, 0)):
        got = {}
        for r in chunk.explode_chunks(frame, "id", chunk.text_chunks(F.col("text"), size, cap)).orderBy("id", "idx").collect():
            got.setdefault(r.id, []).append((r.first, r.last, r.body))
        assert got == {k: c for k, t in enumerate(texts) if (c := plain_chunks(t, size, cap))}


FIELDS = ["owned_areas", "blame", "owns", "top_commits", "first", "repos", "areas", "approved", "approver_for", "maintains", "prs", "reviews"]


def plain_role(w):
    depth, breadth, said = 0.0, 0.0, 0
    for points in (
        1.0 if w["owned_areas"] >= 3 else 0.6 if w["owned_areas"] else 0, 0.8 if w["blame"] >= 0.25 else 0.4 if w["blame"] >= 0.1 else 0, 0.6 if w["owns"] else 0, 0.4 if w["top_commits"] >= 30 else 0,
        (0.5 if (y := (datetime(2024, 1, 1) - w["first"]).days / 365.25) >= 4 else 0.3 if y >= 2 else 0) if w["first"] else 0,
    ):
        depth, said = depth + points, said + (points > 0)
    for points in (
        (0.8 if w["repos"] >= 5 else 0.5 if w["repos"] >= 3 else 0) + (0.6 if w["areas"] >= 20 else 0.3 if w["areas"] >= 10 else 0), 0.6 if w["approved"] >= 5 else 0.3 if w["approved"] >= 3 else 0,
        0.4 if w["approver_for"] >= 3 else 0, 0.4 if w["maintains"] else 0,
    ):
        breadth, said = breadth + points, said + (points > 0)
    acts = w["prs"] + w["reviews"]
    if not (w["areas"] or w["top_commits"] or acts or w["first"]):
        return None, 0.0, 0.0, 0.0
    deep, broad = depth >= 1.2 - 1e-9, breadth >= 1.2 - 1e-9
    level = "lead" if deep and broad else "domain expert" if deep else "contributor"
    return level, round(depth, 1), round(breadth, 1), round(min(0.7, 0.3 + 0.04 * said + min(0.08, 0.02 * math.log2(1 + acts / 10))), 2)


def test_roles(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([0, 1, 4]), rng.choice([0.0, 0.1, 0.3]), rng.choice([0, 1]), rng.choice([0, 30, 90]), rng.choice([None, datetime(2023, 1, 1), datetime(2021, 1, 1), datetime(2015, 1, 1)]), rng.choice([0, 3, 6]), rng.choice([0, 10, 25]), rng.choice([0, 3, 9]), rng.choice([0, 3]), rng.choice([0, 1]), rng.choice([0, 7, 300]), rng.choice([0, 5])) for k in range(120)]
    rows.append((120, 0, 0.0, 0, 0, None, 0, 0, 0, 0, 0, 0, 0))
    frame = spark.createDataFrame(rows, "person int, owned_areas int, blame double, owns int, top_commits int, first timestamp, repos int, areas int, approved int, approver_for int, maintains int, prs int, reviews int")
    got = {r.person: tuple(r)[1:] for r in ownership.roles(frame, F.lit(datetime(2024, 1, 1))).collect()}
    assert len({r[0] for r in got.values()}) == 4
    for person, *values in rows:
        want = plain_role(dict(zip(FIELDS, values, strict=True)))
        assert got[person][0] == want[0] and all(abs(a - b) < 0.011 for a, b in zip(got[person][1:], want[1:], strict=True))


def test_bots(spark):
    names = {"Dependabot[bot]": 1, "renovate-x": 1, "my renovate": 0, "Copilot": 1, "codex": 1, "codex fan": 0, "bot-1": 1, "ci-bot": 1, "Abbot": 0, "github-actions": 1, "noreply@github.com": 1, "Cursor Agent": 1, "claude": 1, "Claudette": 0, "codecov": 0}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.is_bot(F.col("n")).alias("b")).collect()
    assert {r.n: int(r.b) for r in rows} == names
