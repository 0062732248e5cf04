"""Runs of words against a plain search of every period."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomfield.llm import repeats
from loomfield.llm.queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least_words=6, least_periods=4):
    """Every maximal stretch of each period, longest first kept at its smallest period."""
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= max(least_words, least_periods * q) and not any(s <= i and i + j - i + q <= s + n for s, n, _ in found):
                found.add((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def block(texts):
    bounds = np.cumsum([0, *map(len, texts)])
    return np.array([w for t in texts for w in t], np.int64), bounds


def by_text(out, n):
    got = [[] for _ in range(n)]
    for t, s, length, q in zip(*(x.tolist() for x in out), strict=True):
        got[t].append((s, length, q))
    return got


def same(texts, **least):
    assert by_text(repeats.runs(*block(texts), **least), len(texts)) == [plain_runs(t, **least) for t in texts]


WORDS = st.lists(st.integers(0, 2), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(WORDS, st.integers(1, 9)), max_size=4).map(lambda parts: [w for p, n in parts for w in p * n][:150]), max_size=4))
def test_all_squares_and_runs(texts):
    same(texts)
    same(texts, least_words=2, least_periods=2)


def test_hard_shapes():
    fib = [0, 1]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(512)]
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 50, 800).tolist()
    same([b, thue, [7] * 300, fib * 90, noise, noise[:97] * 6, noise[:50] + noise[:60] * 5, [], [1]], least_words=2, least_periods=2)
    same([b, thue, [7] * 300, fib * 90, noise, noise[:97] * 6, noise[:50] + noise[:60] * 5, [], [1]])


def test_long_unary_and_periodic_texts_take_linear_time():
    n = 300_000
    out = repeats.runs(*block([[3] * n, list(range(1000)) * (n // 1000)]))
    assert by_text(out, 2) == [[(0, n, 1)], [(0, n, 1000)]]


def plain(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    held = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = digest("".join(f"{a},{b},{c}\n" for a, b, c in runs))
    left = digest(" ".join(w for i, w in enumerate(words) if i not in held))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, listed, left)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_a_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = [None, "", " \t\n", "a", "x " * 50, "a b\x0bc\fd " * 9, "é ü " * 7 + "日本 " * 7, *[" ".join(rng.choice(list("abcdef"), rng.integers(0, 90))) for _ in range(220)]]
    rows = [*enumerate(texts), *enumerate(texts[:5])]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_periodic_runs(spark, str(tmp_path))
    assert out.columns[:8] == COLUMNS
    got = sorted((tuple(r)[:8] for r in out.collect()), key=str)
    assert got == sorted((plain(*r) for r in rows), key=str)


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string, h int, n int"
    assert repeats.find_runs(repeats.with_planted_runs(spark.createDataFrame([], schema))).collect() == []
    odd = spark.createDataFrame([(None, "b " * 10, 1, 1), (None, None, 1, 1)], schema)
    got = repeats.find_runs(repeats.with_planted_runs(odd)).collect()
    assert sorted((len(r.runs), r.collapsed) for r in got) == [(0, ""), (1, "b")]


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[:8] for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    short = [d for d in docs if len(d.text) < 4000]
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[d.doc_id] == plain(d.doc_id, d.text) for d in short)
