"""Items of services as text."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomfield.functions import items

ISSUE = {
    "key": "AB-1", "self": "https://api.x/1", "url": "https://api.x/2", "webUrl": "https://x/AB-1", "updated": "2024-01-02T03:04:05Z",
    "fields": {
        "summary": "  First line\nsecond ", "status": {"name": "Open", "id": 3}, "assignee": None, "labels": ["a", "b", ""], "avatarUrls": {"x": 1}, "votes": {"n": 2, "who": [{"displayName": "Ann"}, {"x": {"y": {"z": 1}}}]},
        "links": [{"to": "AB-2", "kind": {"name": "blocks"}}, 7], "points": 5, "done": False, "empty": [],
    },
}


def test_columns(spark):
    rows = [json.dumps(ISSUE), json.dumps({"id": 12, "created": 1704164645000, "title": "", "name": 5}), json.dumps({"ts": "1704164645.5", "text": "hi", "created": "1704164645.5"}), "no json", None, "[1]", json.dumps({"id": ""})]
    v = F.col("v")
    frame = spark.createDataFrame(list(enumerate(rows)), "n int, j string").withColumn("v", items.parsed(F.col("j")))
    got = frame.select("n", items.title(v, F.lit("the key")).alias("t"), items.url(v).alias("u"), items.key(v).alias("k"), items.when(v, "updated", "created").alias("at")).orderBy("n").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("First line", "https://x/AB-1", "AB-1", 1704164645), ("the key", "", "12", 1704164645), ("hi", "", "1704164645.5", 1704164645),
        ("the key", "", None, None), ("the key", "", None, None), ("the key", "", None, None), ("the key", "", None, None),
    ]


def test_fields(spark):
    rows = [(0, json.dumps(ISSUE)), (1, None), (2, "nope"), (3, "[1]")]
    got = {r.n: [(f.field, f.text, f.simple) for f in r.f] for r in spark.createDataFrame(rows, "n int, j string").select("n", items.fields(F.col("j")).alias("f")).collect()}
    assert got[1] == got[2] == got[3] == []
    assert got[0] == [
        ("key", "AB-1", True), ("url", "https://api.x/2", True), ("webUrl", "https://x/AB-1", True), ("summary", "First line\nsecond", True), ("status", "Open", True), ("labels", "a, b", False),
        ("votes", "n: 2\n  who: \n    - Ann", False), ("links", "- to: AB-2\n    kind: blocks\n  - 7", False), ("points", "5", True), ("done", "False", True),
    ]
