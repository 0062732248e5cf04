"""Packing: ids, cuts and the mixture against plain versions."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomfield.llm import packing
from loomfield.llm.queries import TOKENIZER_FILE, op13_packing

PATH = public_tokenizers.path(TOKENIZER_FILE)
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True
ENCODER = packing.Encoder(PATH)


def plain_ids(text: str | None) -> list[int]:
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def encoded(texts: list[str]) -> list[list[int]]:
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    out = []
    for ids, ends in ENCODER.rows(np.frombuffer(b"".join(data), np.uint8), bounds):
        out += [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'stEé× \u0085 　\x1c\x0b\n\t .,9½ß\U0001f600", max_size=30), min_size=1, max_size=6))
def test_words_give_the_ids_of_whole_texts(texts):
    assert encoded(texts) == [plain_ids(t) for t in texts]


def test_special_strings_and_long_texts(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)
    texts = ["<|endoftext|> a <|endoftext|>", "", "x" * 500, ("word é " * 50).strip(), "  tail   "]
    assert encoded(texts) == [plain_ids(t) for t in texts]


def plain_order(queues: dict[str, list[int]], window: int, shares: dict[str, float]) -> list[tuple[int, str, int]]:
    """Deficit round-robin, literally: (window, queue, packet)."""
    deficit, at, out, w = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0), [], 0
    while any(at[q] < len(p) for q, p in queues.items()):
        for q in sorted(queues):
            deficit[q] += window * shares[q]
            while at[q] < len(queues[q]) and queues[q][at[q]] <= deficit[q] + 1e-9:
                deficit[q] -= queues[q][at[q]]
                out.append((w, q, at[q]))
                at[q] += 1
        w += 1
    return out


def rows(spark, values, n=3):
    return spark.createDataFrame(values, "doc_id long, text string, source string, part int").repartition(n, "doc_id")


def check(pieces, texts, length):
    """Every id in one piece, sequences gapless, full or of a power of two."""
    whole, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        whole[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(whole) == set(texts)
    for doc, parts in whole.items():
        ids = plain_ids(texts[doc]) + [1]
        got = []
        for start, part, n in sorted(parts):
            assert start == len(got) and n == len(ids)
            got += part
        assert got == ids
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at == length or (at < length and at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))


def corpus():
    rng = np.random.default_rng(1)
    texts = {k: " ".join(rng.choice(["alpha", "beta", "gamma,", "delta\n"], rng.integers(0, 60))) for k in range(120)}
    return texts, {k: ["hot", "b", "c"][0 if k % 3 else k % 9 // 3 % 2 + 1] for k in texts}


def test_deficit_round_robin(spark):
    texts, source = corpus()
    texts[120], source[120] = None, "b"
    texts[121], source[121] = "", "c"
    docs = rows(spark, [(k, t, source[k], 0) for k, t in texts.items()])
    pieces = packing.pack(docs, PATH, length=16, window=256).collect()
    check(pieces, texts, 16)
    held = packing.packets(docs, PATH, 1, 16, "doc_id", "text", "source").collect()
    queues, name = defaultdict(list), defaultdict(list)
    for p in sorted(held, key=lambda p: (p.part, p.at)):
        queues[p.queue].append(p.length)
        name[p.queue].append((p.doc_id, p.start))
    total = sum(map(sum, queues.values()))
    order = plain_order(queues, 256, {q: sum(p) / total for q, p in queues.items()})
    window = {(p.doc_id, p.start): p.window for p in pieces}
    assert all(window[name[q][k]] == w for w, q, k in order)
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    seen = list(dict.fromkeys((p.doc_id, p.start - p.start % 16) for p in stream))
    assert seen == [name[q][k] for _, q, k in order]
    for w in range(1 + max(window.values())):  # after any window each source had its share but for a packet
        for q, sizes in queues.items():
            sent = sum(queues[q][k] for v, p, k in order if p == q and v <= w)
            assert 0 <= (w + 1) * 256 * sum(sizes) / total - sent < 16 or w == max(window.values())


def test_targets(spark):
    texts, source = corpus()
    docs = rows(spark, [(k, t, source[k], 0) for k, t in texts.items()])
    pieces = packing.pack(docs, PATH, length=16, window=256, targets={"b": 1.0, "c": 1.0, "missing": 5.0}).collect()
    check(pieces, texts, 16)
    first = [p for p in pieces if p.window == 1]
    share = lambda s: sum(p.length for p in first if p.source == s)
    assert abs(share("b") - share("c")) <= 32 and share("hot") == 0
    check(packing.pack(docs, PATH, length=16, window=256, targets={"missing": 1.0}).collect(), texts, 16)


def test_edges(spark):
    assert packing.pack(rows(spark, []), PATH).collect() == []
    odd = [(1, "a b", None, 0), (1, "a b", None, 0), (None, None, "null", 0), (2, "c", "", 0)]
    pieces = packing.pack(rows(spark, odd), PATH).collect()
    assert sorted(p.length for p in pieces if p.doc_id == 1 and p.source is None) and sum(p.length for p in pieces) == sum(len(plain_ids(t)) + 1 for _, t, _, _ in odd)
    clash = rows(spark, odd).selectExpr("*", "1 AS queue", "2 AS at", "3 AS ids", "4 AS window", "5 AS start", "6 AS length", "7 AS n", "8 AS first")
    assert packing.pack(clash, PATH).count() == len(pieces)


def test_running_total_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 4)
    keys = [0, 1, 3, 4, 5, 17, 18, 40, 63]
    sums = spark.createDataFrame([(k, k + 1) for k in keys], "w long, n long")
    got = {r.w: r.ahead for r in packing.running(sums, "w", "n", 63).collect()}
    assert got == {k: sum(j + 1 for j in keys if j < k) for k in keys}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    out = op13_packing(spark, f"/root/testdata/{sf}").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    total = sum(len(plain_ids(t)) + 1 for t in texts.values())
    assert sum(p.length for p in out) == total and max(p.sequence_id for p in out) < math.ceil(total / 2048) + 11
    for p in out:
        ids = np.array([*plain_ids(texts[p.doc_id]), 1], "<u4")
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
