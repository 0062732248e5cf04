"""Decontamination against planted passages, and its parts against plain versions."""

import random

import numpy as np

from loomfield.llm import decontaminate as dc


def corpus():
    rng = random.Random(8)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.choice([2, 2, 3])))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(rng.randrange(24, 54)) for _ in range(30)]
    docs, planted = [], set()
    for i in range(300):
        text = prose(rng.choice([1, 30, 120, 600]))
        if i % 10 == 0:
            k = i // 10
            own = items[k].split()
            if i % 20 == 0:
                at = rng.randrange(len(text.split()) + 1)
                parts = text.split()
                text = " ".join(parts[:at]) + "\n" + items[k].upper().replace(" ", ", ") + "\n" + " ".join(parts[at:])
            else:  # a tenth of the words changed
                changed = rng.sample(range(len(own)), len(own) // 10)
                text += " " + " ".join("zzz" if j in changed else w for j, w in enumerate(own)) + " " + prose(20)
            planted.add((i, k))
        docs.append((i, text, "x"))
    return docs, [(k, t) for k, t in enumerate(items)], planted


def test_planted_passages_are_found_and_clean_texts_are_not(spark):
    docs, items, planted = corpus()
    docs = [*docs, (1000, None, "x"), (1001, "", "x"), (0, docs[0][1], "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (90, None), (91, " ! "), items[0]], "item_id long, text string")
    got = dc.contaminated(table.drop("item_id"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    assert sum(r.doc_id == 0 for r in got) == 2 and all(r.share >= dc.PARAPHRASE for r in got)
    left = dc.clean(table, bench)
    assert {r.doc_id for r in left.collect()} == {d[0] for d in docs} - {d for d, _ in planted}
    assert left.columns == table.columns


def test_paraphrase_needs_the_answer(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen paris".split()
    filler = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(50)]
    mixed = [w if k % 3 else "zzz" for k, w in enumerate(base)]
    docs = spark.createDataFrame([*filler, (100, " ".join(mixed)), (101, " ".join(mixed).replace("paris", "rome"))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(base), "Paris")], "item_id long, text string, answer string")
    got = dc.contaminated(docs, bench, answer_col="answer").collect()
    assert [(r.doc_id, r.kind) for r in got] == [(100, "paraphrase")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert dc.contaminated(docs, bench.where("false")).collect() == []
    assert dc.contaminated(docs.where("false"), bench).collect() == []
    assert dc.clean(docs, bench.where("false")).collect() == docs.collect()


def test_subsequence_and_latent_space():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 80)), rng.integers(-1, 5, rng.integers(1, 150))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert dc.common_subsequence(a, b) == table[-1, -1]
    counts = rng.poisson(0.3, (500, 40)).astype(float)
    omega = rng.choice(np.array([-1, 1], np.float32), (40, 40))
    idf, rows = dc.latent(500, (counts > 0).sum(0), counts.T @ (counts @ omega), omega, 10)
    _, s, v = np.linalg.svd(counts * idf, full_matrices=False)
    want = (idf[:, None] * v[:10].T / np.sqrt(s[:10])) @ (idf[:, None] * v[:10].T / np.sqrt(s[:10])).T
    assert np.allclose(rows @ rows.T, want, atol=1e-2 * abs(want).max())


def test_copies_outside_the_leading_directions_are_found(spark, monkeypatch):
    docs, items, planted = corpus()
    monkeypatch.setattr(dc, "COSINE", 2.0)
    table = spark.createDataFrame(docs, "doc_id long, text string, x string").drop("x")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(table, bench).collect()} == planted


def test_items_of_common_words_are_found(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.sample(words, 30))) for i in range(6)]
    docs = [(i, " ".join(f"f{i}x{j}" for j in range(90)) + " " + items[i][1]) for i in range(6)] + [(9, "other words " * 50)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(table, bench).collect() if r.kind == "copy"}
    assert got == {(i, i) for i in range(6)}


def test_paraphrases_of_items_without_an_answer_are_found(spark):
    docs, items, _ = corpus()
    rng = random.Random(6)
    docs = [d for d in docs if d[0] % 10]
    want = set()
    for i, (k, text) in enumerate(items):
        own = text.split()
        changed = set(rng.sample(range(len(own)), int(len(own) * (0.25, 0.35, 0.45)[k % 3])))
        docs.append((1000 + i, " ".join("zzz" if j in changed else w for j, w in enumerate(own)) + " " + docs[i][1], "x"))
        want.add((1000 + i, k))
    table = spark.createDataFrame(docs, "doc_id long, text string, x string").drop("x")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(table, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_an_item_under_two_ids_is_found_under_both(spark):
    docs, items, planted = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string, x string").drop("x")
    bench = spark.createDataFrame([(n + k, t) for k, t in items[:10] for n in (0, 100)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in dc.contaminated(table, bench).collect()}
    assert set(got) == {(i, n + k) for i, k in planted if k < 10 for n in (0, 100)}
