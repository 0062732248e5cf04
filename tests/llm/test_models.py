"""Classifier and language identification: held-out accuracy, edge rows, training on both classes or one."""

import random

import numpy as np
import pytest

from loomfield.llm import language_id, quality_classifier
from loomfield.llm.common import blocks, by_row, code_points, text_buffer
from loomfield.llm.queries import op2_quality_classifier, op10_language_id

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in op2_quality_classifier(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) > 0.95 * len(labels)


def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in op10_language_id(spark, SF).collect()}
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) > 0.97 * len(rows)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog sat on the mat", "en", 1) for i in range(4)] + [(i, "le chat et le chien sur la table", "fr", 1) for i in range(4, 8)]
    learn = spark.createDataFrame([*rows, (9, None, "fr", 1), (10, "nothing known", None, 1)], "doc_id long, text string, lang string, score int")
    model = language_id.fit(learn)
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "Le Chat"), (5, "the mat"), (5, "the mat"), (None, "the dog"), (6, "é")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(asked, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (5, "en"), (5, "en"), (None, "en"), (6, got[-1][1])], key=str)
    assert got[-1][1] in ("en", "fr")
    empty = language_id.fit(learn.where("false"))
    assert [r.lang_pred for r in language_id.predict(asked.limit(4), empty).collect()] == ["und"] * 4


def test_language_counts_are_those_of_a_loop(spark):
    texts = ["ab", "Abc é", "", "x y"]
    docs = spark.createDataFrame([(t, "l") for t in texts], "text string, lang string")
    got = {r.bucket: r.n for r in language_id.counts(docs, "text", "lang").collect()}
    assert got.pop(-1) == 4 and sum(got.values()) == sum(max(0, len(t) - n + 1) for t in texts for n in language_id.ORDERS)


def test_features_do_not_cross_rows_and_words_hash_alike():
    texts = ["one two", "two", "two two", "", "o"]
    data = "".join(texts).encode()
    points, bounds = code_points(data, np.cumsum([0, *[len(t.encode()) for t in texts]]))
    together = [list(f) for f in quality_classifier.features(points, bounds, (3,), 1 << 18)]
    for k, text in enumerate(texts):
        own = quality_classifier.features(*code_points(text.encode(), np.array([0, len(text.encode())])), (3,), 1 << 18)
        alone = sorted(b for bucket, _ in own for b in bucket.tolist())
        inside = sorted(b for bucket, at in together for b, a in zip(bucket.tolist(), at.tolist()) if bounds[k] <= a < bounds[k + 1])
        assert alone == inside, text


def test_classifier_edges(spark):
    table, intercept = quality_classifier.train([("good words here", 1)])
    assert not table.any() and intercept > 0
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "x" * 100_000, "s")], "doc_id long, text string, score string")
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(docs, quality_classifier.train([])).collect())
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    rows = quality_classifier.sample(docs, labels, "doc_id", "text", "quality", 10, 1 << 20)
    assert sorted((len(t), y) for t, y in rows) == [(0, 1), (100_000, 0)]
    assert len(quality_classifier.sample(docs, labels, "doc_id", "text", "quality", 10, 10)) == 1
    assert quality_classifier.sample(docs, labels.where("false"), "doc_id", "text", "quality", 10, 10) == []


def test_buffers():
    import pyarrow as pa

    for kind in (pa.string(), pa.large_string()):
        data, offsets = text_buffer(pa.array(["x", "é", None, "", "zz"], kind)[1:])
        assert bytes(data) == "ézz".encode() and offsets.tolist() == [0, 2, 2, 2, 4]
        assert list(blocks(offsets, 2)) == [(0, 3), (3, 4)] or list(blocks(offsets, 2))[-1][1] == 4
    rng = random.Random(1)
    sizes = np.array([rng.randrange(9) for _ in range(50)])
    cuts = list(blocks(np.concatenate([[0], np.cumsum(sizes)]), 5))
    assert cuts[0][0] == 0 and cuts[-1][1] == 50 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert by_row(np.array([1.0, 2.0, 4.0]), np.array([0, 0, 2, 3])).tolist() == [0.0, 3.0, 4.0]


@pytest.mark.parametrize("text", ["", "a", "é"])
def test_short_code_points(text):
    points, bounds = code_points(text.encode(), np.array([0, len(text.encode())]))
    assert len(points) == len(text) == bounds[-1]
