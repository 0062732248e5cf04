"""Parsers on small inputs written to disk, usage rules with their literal results."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomfield.sources import connectors, files, transcripts as tr


def raw(spark, lines, file="f"):
    return spark.createDataFrame([(file, i, json.dumps(x) if not isinstance(x, str) else x) for i, x in enumerate(lines)], "file string, line long, value string")


def test_lines_and_turns(spark, tmp_path):
    (tmp_path / "a").mkdir()
    rows = [
        {"type": "user", "message": {"role": "user", "content": "hi <system-reminder>x\ny</system-reminder>"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "one"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"c": 1}}, {"type": "text", "text": "two"}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "out"}]}},
        {"type": "user", "isMeta": True, "message": {"role": "user", "content": "meta"}},
        {"type": "user", "isSidechain": True, "message": {"role": "user", "content": "side"}},
        "not json", "",
    ]
    (tmp_path / "a/s.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    read = tr.lines(spark, str(tmp_path))
    assert [(r.role, r.text) for r in tr.claude_turns(read).orderBy("line").collect()] == [("user", "hi"), ("assistant", "one\ntwo")]
    call = tr.tool_calls(read).first()
    assert (call["name"], call["result"]) == ("Bash", "out")


def test_other_agents(spark):
    qwen = raw(spark, [{"type": "user", "message": {"parts": [{"text": "a"}, {"text": "t", "thought": True}]}}, {"type": "assistant", "subtype": "cron", "message": {"parts": [{"text": "b"}]}}])
    assert [r.text for r in tr.qwen_turns(qwen).collect()] == ["a"]
    codex = raw(spark, [{"payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}}, {"payload": {"type": "token_count"}}])
    assert [(r.role, r.text) for r in tr.codex_turns(codex).collect()] == [("user", "q")]
    memory = spark.createDataFrame([("d/note.md", "---\nname: Plan\nx: 1\n---\nbody\n"), ("d/plain.md", "just text")], "file string, value string")
    assert {(r.title, r.text) for r in tr.memory_session(memory).collect()} == {("Plan", "body"), ("plain", "just text")}


@pytest.mark.parametrize("lines, want", [([{"aiTitle": "a"}, {"customTitle": "c"}, {"aiTitle": "b"}], "c"), ([{"customTitle": "c"}, {"customTitle": ""}, {"aiTitle": "b"}], "b"), ([{"agentName": "n"}, {"customTitle": "c"}], "n"), ([{"x": 1}], None)])
def test_titles(spark, lines, want):
    got = [r.chosen for r in tr.session_titles(raw(spark, lines)).collect()]
    assert got == ([want] if want else [])


def usage(i, model="m", **u):
    return {"type": "assistant", "timestamp": "2026-10-01T10:20:00Z", "message": {"id": i, "model": model, "usage": u}}


def test_usage(spark):
    lines = [usage("a", input_tokens=1, output_tokens=2), usage("a", input_tokens=5, output_tokens=7, cache_creation_input_tokens=3), usage("b", input_tokens="x", output_tokens=None)]
    got = {r.id: (r.input, r.output, r.cache_write, r.cache_read) for r in tr.claude_usage(raw(spark, lines)).collect()}
    assert got == {"a": (5, 7, 3, 0), "b": (0, 0, 0, 0)}
    hour = tr.usage_by_hour(tr.claude_usage(raw(spark, lines))).first()
    assert (hour.calls, hour.input, str(hour.hour)) == (2, 5, "2026-10-01 10:00:00")
    count = lambda total, i, c: {"payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": total}, "last_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": 1}}}}
    got = [(r.input, r.cache_read) for r in tr.codex_usage(raw(spark, [count(10, 9, 4), count(10, 9, 4), count(20, 8, 0)])).orderBy("line").collect()]
    assert got == [(5, 4), (8, 0)]
    line = {"uuid": "u", "timestamp": "2026-10-01T10:20:00Z", "model": "q", "usageMetadata": {"promptTokenCount": 10, "candidatesTokenCount": 3, "thoughtsTokenCount": 4, "cachedContentTokenCount": 6}}
    r = tr.qwen_usage(raw(spark, [line])).first()
    assert (r.input, r.output, r.cache_read) == (4, 7, 6)


def test_walk_and_extract(spark, tmp_path):
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>one &amp;</w:t></w:p><w:p><w:t>two</w:t></w:p>")
    for name, data in {"a.docx": word.getvalue(), "b.html": b"<p>x</p>y", "c.txt": b"t\0", "d.md": b"# d", ".env": b"K=1", "bad.docx": b"zz", "m.eml": b"Subject: S\n\nbody"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("x")
    got = {r.path.rpartition("/")[2]: r.text for r in files.extract(files.walk(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": "one &\ntwo", "b.html": "x\ny", "c.txt": "", "d.md": "# d", "bad.docx": "", "m.eml": "S\nbody"}


def test_git_exports(spark):
    log = ["@s1\t1700000000\tA <a@x>\tfix (#7)", "", "3\t1\tsrc/a.py", "-\t-\tlogo.png", "@s2\t1700000100\tB <b@x>\tmore", "2\t0\tb.py"]
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate(log)], "repo string, line long, value string")
    assert sorted((r.sha, r.path, r.added, r.deleted) for r in files.git_log(rows).collect()) == [("s1", "logo.png", 0, 0), ("s1", "src/a.py", 3, 1), ("s2", "b.py", 2, 0)]
    blame = ["a" * 40 + " 1 1 1", "author Ann", "author-time 1700000000", "\tline one", "0" * 40 + " 2 2", "author Not Committed Yet", "author-time 1700000200", "\tline two"]
    rows = spark.createDataFrame([("r", "p", i, v) for i, v in enumerate(blame)], "repo string, path string, line long, value string")
    assert sorted((r.n, r.author) for r in files.git_blame(rows, "me").collect()) == [(1, "Ann"), (2, "me")]
    owners = spark.createDataFrame([("*.py @a @b # note",), ("# all",), ("docs/ @a",)], "value string")
    assert {(r.owner, r.n) for r in files.codeowners(owners).collect()} == {("@a", 2), ("@b", 1)}
    chat = spark.createDataFrame([("=== Message from Ann B (U1) at x ===\nhello\n=== Message from Cy (U2) ===\nbye",)], "value string")
    assert [(r.user, r.name, r.body.strip()) for r in files.chat_messages(chat).collect()] == [("U1", "Ann B", "hello"), ("U2", "Cy", "bye")]


def test_connectors(spark):
    result = {"data": {"items": [{"id": 1, "title": "x"}, {"id": 2, "title": "y"}], "users": [{"id": 9}]}}
    rows = spark.createDataFrame([(1, json.dumps(result)), (2, "broken"), (3, None)], "row long, raw string")
    items = connectors.split(rows)
    assert [json.loads(r.item)["title"] for r in items.collect()] == ["x", "y"]
    issue = spark.createDataFrame([(json.dumps({"html_url": "https://g/o/r/pull/3", "title": "T", "state": "open", "user": {"login": "ann"}}),), ("{}",)], "item string")
    r = connectors.normalise(issue, "github").collect()
    assert len(r) == 1 and (r[0].kind, r[0].person, r[0].status) == ("pr", "ann", "open")
    states = spark.createDataFrame([(s,) for s in ("Done", "In Review", "In Progress", "Backlog", None)], "s string")
    assert [x.v for x in states.select(connectors.status_state(F.col("s")).alias("v")).collect()] == ["done", "close", "progress", "todo", "todo"]
