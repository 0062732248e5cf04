"""Removal of repeats against a plain version that counts every window."""

import hashlib
import random
from collections import Counter

import numpy as np

from loomfield.llm import suffix_dedup


def brute(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + least] for t in raw for i in range(len(t) - least + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, edited = prose(80), prose(400).split(" ")
    texts = [prose(n) for n in (1, 30, 100, 500)] + [prose(50) + shared + prose(60), shared, shared + "!", prose(9) + shared[:250] + prose(40)]
    near = [" ".join(w if rng.random() > 0.01 else "X" for w in edited) for _ in range(6)]
    loops = ["ab" * 300, "é" * 500, "Ber " * 200, "x" * 199, "x" * 200, "y" * 201, prose(60) * 3, "z" * 90 + prose(70) + "z" * 90]
    copies = [texts[3]] * 3 + [texts[2]]
    return [*texts, " ".join(edited), *near, *loops, *copies, None, "", "short"]


def test_repeats_are_those_of_the_plain_version(spark):
    texts = corpus()
    rows = [(i, t, "row") for i, t in enumerate(texts)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    want = brute(texts, 200)
    assert [got[i] for i in range(len(texts))] == want


def test_hot_keys_take_the_other_path_to_the_same_end(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 2)
    texts = corpus()
    out = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_transform_against_counting():
    rng = random.Random(9)
    for least in (3, 8, 20):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))).encode() for _ in range(20)]
        counts = np.array([rng.choice([1, 1, 2]) for _ in texts])
        seen = Counter()
        for t, n in zip(texts, counts):
            for i in range(len(t) - least + 1):
                seen[t[i : i + least]] += n
        for t, got in zip(texts, suffix_dedup.repeated_windows(texts, counts, least)):
            starts = [i for a, b in got for i in range(a, b - least + 1)]
            assert starts == [i for i in range(len(t) - least + 1) if seen[t[i : i + least]] > 1]


def test_same_id_rows_and_empty_table(spark):
    text = "".join(random.Random(4).choice("abcdef") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + "g")], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()) == [300, 300, 300]
    assert suffix_dedup.remove_repeats(docs.where("false")).collect() == []
