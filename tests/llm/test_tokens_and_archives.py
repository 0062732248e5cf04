"""Encoding against the library on whole texts, archives by exact round trip, line removal against counts."""

import hashlib
import random

import public_tokenizers
import pytest

from loomfield.llm import byte_bpe, line_dedup, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts():
    rng = random.Random(6)
    letters = "abc déß日本 \n\t'sé12!?  𝒳"
    return [None, "", " ", "a", "<|endoftext|>", "it's we'll 123 abc", "x" * 70_000, "ab " * 40_000, "".join(rng.choice(letters) for _ in range(200_000))]


def test_ids_are_the_library_s_and_decode_to_the_bytes(spark):
    rows = [(i, t, "n") for i, t in enumerate(texts())] + [(3, "a", "n"), (None, "b", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    codec = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for r in out.collect():
        text = (rows[r.doc_id][1] if r.doc_id is not None else "b") or ""
        assert r.ids == codec.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(out, RANKS, public_tokenizers.PATTERN).collect()}
    assert back[8].decode() == texts()[8]
    assert byte_bpe.encode(docs.where("false"), RANKS, public_tokenizers.PATTERN).collect() == []


def test_cuts_change_no_id():
    codec = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in texts():
        if text:
            assert "".join(byte_bpe.pieces(text, 50)) == text
            assert byte_bpe.encode_text(codec, text[:20_000], 50) == codec.encode_ordinary(text[:20_000])


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'é' * (i % 5)}{i % 4}</p>", "x") for i in range(40)]
    rows += [(40, None, None, "x"), (41, "u", "", "x"), (43, "u", "<p>once</p>", "x"), (43, "u", "<p>once</p>", "x"), (42, "u", "y" * 300_000, "x")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


@pytest.mark.parametrize("least", [0, 12])
def test_archives_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    rows, table = pages(spark)
    folder = warc.scratch(spark)
    manifest = warc.write(table, folder, min_payload=least)
    got = warc.read(spark, folder, manifest).collect()
    assert len(got) == len(rows) and manifest.count() > 1
    body = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in got:
        key = int(r.record_id)
        equal = [i for i, b in body.items() if b == body[key]]
        last = max(equal)
        revisit = len(body[key]) >= least and key != last
        assert (r.record_type, r.refers_to) == (("revisit", str(last)) if revisit else ("response", None))
        assert r.payload_bytes == len(body[key]) and r.payload_digest == warc.digest(body[key])
        assert r.payload is None if revisit else bytes(r.payload) == body[key]
    assert warc.round_trip(table.where("false")).collect() == []


def test_damage_is_found():
    data = warc.archive([warc.record("response", str(i), "u", b"body", 4, warc.digest(b"body"), None) for i in range(20)])
    items = list(warc.frames(memoryview(data)))
    assert len(items) == 20 and warc.parse(items[3])[0]["warc-record-id"] == "<urn:page:3>"
    for bad in (items[0].replace(b"WARC/1.1", b"WARC/9.9"), items[0][:-1], items[0] + b"x", items[0].replace(b"body", b"bodx"), items[0].replace(b"WARC-Date", b"X")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.frames(memoryview(data[:-3])))


def test_lines_on_too_many_pages_of_a_host_go(spark):
    rng = random.Random(3)
    rows = [(i, f"h{i % 3}", "\n".join(rng.choice(["menu", " menu\t", f"own {i}", "", "footer" if i % 9 == 0 else f"x{i}"]) for _ in range(rng.randrange(8))), "k") for i in range(90)]
    rows += [(90, None, "menu", "k"), (91, "h0", None, "k"), (92, "h0", "", "k"), (0, "h0", rows[0][2], "k")]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string, n_lines string")
    total, seen = {}, {}
    for _, h, t, _ in rows:
        total[h] = total.get(h, 0) + 1
        for line in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""}:
            seen[h, line] = seen.get((h, line), 0) + 1
    want = []
    for i, h, t, _ in rows:
        lines = None if t is None else t.split("\n")
        kept = None if t is None else [x for x in lines if h is None or not (n := seen.get((h, x.strip(" \t\r")), 0)) >= 5 or not n > 0.1 * total[h]]
        want.append((i, h, None if t is None else "\n".join(kept), 0 if t is None else len(lines), 0 if t is None else len(lines) - len(kept)))
    got = [(r.doc_id, r.source, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[4] for w in want)
    assert line_dedup.drop_lines(table.where("false")).collect() == []
