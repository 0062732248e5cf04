"""Golden cases of the query language, globs and scores."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.plans.grammar import Fields, parse, predicate, when

NOW = dt.datetime(2026, 10, 5, 12)


@pytest.mark.parametrize(
    "value, end, want",
    [
        ("2026-10-01", False, dt.datetime(2026, 10, 1)), ("2026-10-01", True, dt.datetime(2026, 10, 2)), ("12h", False, dt.datetime(2026, 10, 5)),
        ("3d", False, dt.datetime(2026, 10, 2, 12)), ("2w", True, dt.datetime(2026, 9, 21, 12)), ("1m", False, dt.datetime(2026, 9, 5, 12)),
        ("yesterday", False, dt.datetime(2026, 10, 4)), ("Today", True, dt.datetime(2026, 10, 6)),
    ],
)
def test_when(value, end, want):
    assert when(value, NOW, end) == want


@pytest.mark.parametrize("value", ["last-week", "3 days", "2026-13-01", ""])
def test_bad_times(value):
    with pytest.raises(ValueError):
        when(value, NOW)


def test_parse():
    q = parse("retry backoff since:2026-10-01 until:2026-10-02 project:Payments-API", NOW)
    assert q.semantic == "retry backoff" and q.filters["since"] < q.filters["until"] and q.filters["project"] == "payments-api"
    q = parse('"rate limit" -"old notes" -draft -p --flag -1 kind:docs ext:.PDF person:Sam "open', NOW)
    assert q.exact == ["rate limit", "open"] and q.exclude == ["old notes", "draft"]
    assert q.words == ["-p", "--flag", "-1", "Sam"] and q.filters == {"kind": "person", "ext": "pdf"}
    assert parse("", NOW).words == [] and parse('""', NOW).exact == [] and parse("a:b kind:", NOW).words == ["a:b", "kind:"]


def test_filter_on_a_missing_column_drops_all(spark):
    rows = spark.createDataFrame([("a b",), (None,)], "text string")
    assert rows.where(predicate(parse("ext:md", NOW), Fields())).count() == 0
    assert rows.where(predicate(parse('"A B"', NOW), Fields())).count() == 1
    assert rows.where(predicate(parse("", NOW), Fields())).count() == 2


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = rows.where(predicate(parse("kind:code project:src1", NOW), Fields(kind="lang", project="source"))).select("doc_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,code)]" in text and "text" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize(
    "path, glob, hit",
    [("a/b.py", "*.py", False), ("b.py", "*.py", True), ("a/b.py", "**/*.py", True), ("b.py", "**/*.py", True), ("a/x/b.py", "a/*/b.py", True), ("a/x/y/b.py", "a/*/b.py", False), ("a/x/y/b.py", "a/**", True), ("b1.py", "b?.py", True)],
)
def test_globs(path, glob, hit):
    assert bool(re.match(tx.glob_regex(glob), path)) == hit


@pytest.mark.parametrize(
    "path, deployed, test",
    [
        ("web/dist/app.js", False, False), ("dist", True, False), ("a/.venv/x.py", False, False), ("third_party/x.c", False, False), ("Gemfile.lock", False, False),
        ("x/composer.lock", False, False), ("my.lock", True, False), ("a/app.min.css", False, False), ("a/app.js.map", False, False), ("generated/x.py", True, False),
        ("e2e/login.ts", True, True), ("src/__mocks__/db.js", True, True), ("a/docs/schema/x.json", True, True), ("a/b.spec.ts", True, True), ("test_a.py", True, True),
        ("src/attest/a.py", True, False), ("tests", True, False),
    ],
)
def test_path_classes(spark, path, deployed, test):
    row = spark.createDataFrame([(path,)], "p string").select(tx.is_deployed(F.col("p")), tx.is_test_path(F.col("p"))).first()
    assert tuple(row) == (deployed, test)


@pytest.mark.parametrize(
    "mail, kind",
    [
        ("a@Gmail.com", "personal"), ("a@163.com", "personal"), ("1+a@users.noreply.github.com", "noreply"), ("a@acme.io", "work"), ("noreply@acme.io", "work"),
        ("a@box.local", "placeholder"), ("you@example.com", "placeholder"), ("a@(none)", "placeholder"), ("a", "placeholder"), ("a@test.example", "placeholder"),
    ],
)
def test_mail_classes(spark, mail, kind):
    assert spark.createDataFrame([(mail,)], "m string").select(tx.mail_class(F.col("m"))).first()[0] == kind
