"""Each stage of the pipeline against a plain version of its decision, on planted cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomfield.llm import line_dedup
from loomfield.llm import near_copies as nc
from loomfield.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.choice([1, 2, 3]))) for _ in range(n))


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(12)
    rows, expected = [], {}
    for g in range(40):
        base = prose(rng, rng.choice([60, 250, 700])).split()
        for c in range(1 + g % 4):
            copy = list(base)
            for _ in range(len(base) // 120 if c else 0):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows) + 5, " ".join(copy)))
            expected[rows[-1][0]] = len(rows) + 4 - c
    rows += [(900, rows[3][1]), (None, rows[0][1]), (901, None), (902, ""), (903, "short one"), (904, "Short ONE")]
    expected |= {900: expected[rows[3][0]], 901: 901, 902: 901, 903: 903, 904: 903}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group for r in nc.near_copies(table).collect()}
    alike = [i for i in expected if nc.similarity(dict(rows)[expected[i]] or "", dict(rows)[i] or "") >= 0.8]
    assert all(got[i] == expected[i] for i in alike) and len(alike) > 90
    assert all(got[i] in (i, expected[i]) for i in got)
    left = sorted(nc.drop_near_copies(table).collect(), key=str)
    assert {r.doc_id for r in left} == {None} | {i for i in got if got[i] == i}


def test_decoding_finds_the_nearest_codeword():
    words = nc.codewords()
    assert words.shape == (4096, 23)
    near = words[:64].astype(int) @ words.astype(int).T  # 23 less two for each differing place
    assert sorted(set(near.ravel().tolist())) == [23 - 2 * d for d in (23, 16, 15, 12, 11, 8, 7, 0)]
    rows = np.random.default_rng(1).normal(size=(40, nc.BITS)).round(3).astype(np.float32)
    got = nc.decoded(rows, words)
    for row, own in zip(rows.reshape(40, nc.SEGMENTS, 23), got, strict=True):
        assert [max(range(4096), key=lambda k: float(words[k] @ part)) for part in row[:2]] == own[:2].tolist()


def test_shingles_and_prints_are_those_of_plain_versions():
    text = "One two\tTHREE four  five six\nseven one two three four five " * 3
    found = text.lower().split()
    assert len(nc.shingle_set(text.encode())) == len({tuple(found[i : i + 5]) for i in range(len(found) - 4)})
    assert np.array_equal(nc.shingle_set(text.encode()), nc.shingle_set(" ".join(found).encode()))
    assert len(nc.shingle_set(b" \n")) == 0 and len(nc.shingle_set(b"one")) == 1
    assert nc.shingle_set("É two".encode())[0] != nc.shingle_set("é two".encode())[0]
    long = " ".join(f"w{i % 70001}" for i in range(400_000))  # over two parts
    assert len(nc.shingle_set(long.encode())) == 70001
    marks = nc.sketch(nc.margins(nc.shingle_set(text.encode()))[None])
    assert marks.shape == (1, 2) and not nc.margins(np.zeros(0, np.uint64)).any()


def brute_groups(rows, least=0.8):
    """Least id of each row's component by all pairs of texts."""
    sets = {}
    for i, text in rows:
        found = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        k = min(5, len(found))
        sets[i] = frozenset(tuple(found[j : j + k]) for j in range(len(found) - k + 1)) if found else frozenset()
    of, ids = {i: i for i in sets}, sorted(sets)
    links = []
    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or min(len(sets[a]), len(sets[b])) >= least * max(len(sets[a]), len(sets[b]))):
                if sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                    links.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(of[a], of[b])
            changed |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    return of


def test_groups_are_those_of_all_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute_groups([tuple(r) for r in table.collect()])
    got = {r.doc_id: r.group for r in nc.near_copies(table).collect()}
    joined = [i for i in want if want[i] != i]
    assert all(want[got[i]] == want[i] for i in got), "a link that all pairs lack"
    assert len(joined) > 50 and sum(got[i] == want[i] for i in joined) >= 0.95 * len(joined)


def test_texts_ruled_by_one_repeated_shingle_are_no_copies(spark):
    rng = random.Random(4)
    rows = [(i, "nan " * 400 + prose(rng, 100)) for i in range(6)]
    assert max(nc.similarity(rows[0][1], t) for _, t in rows[1:]) < 0.1
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.group == r.doc_id for r in nc.near_copies(table).collect())


def test_blocks_join_what_any_pair_joins(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for g in range(3):
        base, other = prose(rng, 100).split(), prose(rng, 100).split()
        rows += [(10 * g + i, " ".join(other[: 6 * i] + base[6 * i :])) for i in range(6)]
    want = brute_groups(rows)
    assert len(set(want.values())) < len(rows)
    monkeypatch.setattr(nc, "NEAREST", 1)
    monkeypatch.setattr(nc, "BLOCK", 2)
    # With one key for all there is one bucket, dealt out in tiles.
    monkeypatch.setattr(nc, "TILE", 4)
    monkeypatch.setattr(nc, "decoded", lambda of_rows, words: np.zeros((len(of_rows), 16), np.int64))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.group for r in nc.near_copies(docs).collect()} == want


def test_large_group_of_a_chain_of_copies(spark):
    rng = random.Random(21)
    base = prose(rng, 300).split()
    rows = []
    for i in range(200):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = f"changed{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.group for r in nc.near_copies(docs).collect()} == brute_groups(rows)


def test_rows_without_text_or_id_and_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id string, text string, key int")
    assert nc.near_copies(docs).collect() == [] and nc.drop_near_copies(docs).collect() == []
    docs = spark.createDataFrame([("b", None, 1), ("a", "", 2), (None, "x", 3), ("c", "x", 4), ("c", "y", 5)], "doc_id string, text string, key int")
    assert sorted(map(tuple, nc.drop_near_copies(docs).collect()), key=str) == sorted([("a", "", 2), (None, "x", 3), ("c", "x", 4), ("c", "y", 5)], key=str)


def test_stages_run_in_order_and_keep_the_columns(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, SF))
        assert now.columns == docs.columns, name
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[-1] > counts[0] // 2
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert len(last) == counts[-1] and all(r.n_tokens == len(r.ids) for r in last)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) > 0.95 * len(labels)


def test_lines_stage_drops_what_a_count_drops(spark):
    rows = [(i, f"unique {i}\n  menu line \nbody {i % 3}", "en", "site", 9) for i in range(30)]
    rows += [(100 + i, f"text {i}\nmenu line", "en", f"small{i}", 9) for i in range(4)] + [(200, None, "en", None, None), (201, "menu line", "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert len(got) == len(rows) and got[3].text == "unique 3" and got[3].n_chars == 8
    assert got[100].text == "text 0\nmenu line" and got[200].text is None and got[201].text == "menu line"


INTERNAL = ("_host", "_lines", "_salt", "_row_salt", "_kept", "_maybe", "_low", "_word", "_bits", "__lines", "N_LINES", "n_dropped", "host", "lines", "page", "node", "first", "component", "rep", "id", "a", "b", "row")


def test_extra_columns_may_have_any_name(spark):
    """Names that the operators use within: the same rows stay, with the same texts, and the columns keep their values."""
    rng = random.Random(5)
    base = [(i, "shared line\n" + prose(rng, 60), "s") for i in range(12)]
    base += [(100, base[0][1], "s"), (101, None, "s"), (102, "alone " + prose(rng, 40), None)]
    plain = spark.createDataFrame(base, "doc_id long, text string, source string")
    extra = plain.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in INTERNAL])
    kept = {tuple(r) for r in nc.drop_near_copies(plain, "doc_id", "text").select("doc_id", "text").collect()}
    got = nc.drop_near_copies(extra, "doc_id", "text")
    assert got.columns == extra.columns and {tuple(r) for r in got.select("doc_id", "text").collect()} == kept and len(kept) == 14
    assert all(r[n] == f"{n} {r.doc_id}" for r in got.collect() for n in INTERNAL)
    lines = lambda rows: {tuple(r) for r in line_dedup.drop_lines(rows, "source", "text").select("doc_id", "text", "n_lines", "n_dropped").collect()}
    assert lines(extra) == lines(plain) and any(r[3] for r in lines(plain))
    dropped = line_dedup.drop_lines(extra, "source", "text").collect()
    assert all(r[n] == f"{n} {r.doc_id}" for r in dropped for n in INTERNAL if n.lower() not in ("n_lines", "n_dropped"))
