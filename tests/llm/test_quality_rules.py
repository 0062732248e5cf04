"""Counts against a plain version; the estimates against numpy's."""

import random
import re

import numpy as np

from loomfield.llm import quality_rules as rules

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(1)
    vocabulary = ["the", "Élan", "of", "###", "a|b", "été", "x", "日本", "end."]
    free = [" ".join(rng.choice(vocabulary) + str(rng.randrange(4)) for _ in range(n)) for n in (1, 7, 8, 9, 40, 90)]
    loop = ["one two three four five six seven eight nine " * 3, "same " * 30, "a\n\nb\na\n \nb\na", "w " * 8, "q " * 9]
    return [None, "", " \n\t", "\x0b lead", *free, *loop, free[4] + "\n" + free[4], free[5] + " " + free[5][: len(free[5]) // 2]]


def test_counts(spark):
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(texts())]
    out = rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in out:
        want = brute(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, rows[r.doc_id][1]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_empty_table(spark):
    assert rules.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimate_is_that_of_numpy_and_rejects_planted_outliers(spark):
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal([1.8, 0.3, 0.2, 0.4], [0.2, 0.3, 0.2, 0.4], (400, 4)))
    x[:60] += [0.0, 4.0, 0.0, 0.0]
    table = spark.createDataFrame([("g", i % rules.SALTS, *map(float, r)) for i, r in enumerate(x)], ["group", "salt", *rules.NAMES])
    got = rules.estimates(table).first()
    floors = np.array(list(rules.FLOORS.values()))
    centre = np.array([np.sort(c)[199] for c in x.T])
    factor = np.diag(np.abs(x - centre).mean(0) + floors)
    for _ in range(rules.STEPS):
        d = (np.linalg.solve(factor, (x - centre).T) ** 2).sum(0)
        near = x[d <= np.sort(d)[299]]
        centre, factor = near.mean(0), np.linalg.cholesky(np.cov(near.T, bias=True) + np.diag(floors**2))
    d = (np.linalg.solve(factor, (x - centre).T) ** 2).sum(0)
    assert np.allclose([got["m_" + c] for c in rules.NAMES], centre)
    assert np.allclose([[got[f"l_{i}{j}"] for j in range(i + 1)] for i in range(4)][3], factor[3])
    scale = max(1, np.sort(d)[199] / rules.MEDIAN)
    assert (d[:60] / scale > rules.CUTOFF).mean() > 0.9 and (d[60:] / scale <= rules.CUTOFF).all()


def test_rows_repeat_and_groups_fall_back(spark):
    good = "plain words of a clean text that goes on and on without any odd thing in it at all my dear reader of rows"
    rows = [(i % 70, f"{good} {i}", None if i % 2 else "en", "s", "") for i in range(140)]
    out = rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 140 and all(r.kept for r in out)
