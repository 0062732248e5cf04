"""The source divergence audit against a plain version on odd rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from loomfield.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(rows, least=3, top=200):
    """(lang, source, part, item) -> (value, rank) from (text, lang, source)."""
    count, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text or ""))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
        sources[lang].add(source)
    out = {}
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(count[lang, s][t] for t in kept) for s in names}
        share = lambda n, of: 1 + divergence.SCALE * (n + 1) // (of + len(kept))  # noqa: E731, B023
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in names}
        q = {t: share(sum(count[lang, s][t] for s in names), sum(total.values())) for t in kept}
        for s in names:
            f = lambda a, b: (a - b) ** 2 // b
            pair = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in names if o != s}
            term = {t: f(p[s][t], q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]}
            for part, values, most in (("pair", pair, len(pair)), ("term", term, top)):
                for r, (item, v) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item] = (v, r)
    return out


def rows():
    rng = np.random.default_rng(4)
    words = ["The", "the", "naïve", "ÉCOLE", "x", "日本", "b2b", "it's", "zz", "𝒳y", *[f"w{chr(97 + k)}" for k in range(26)]]
    p = 1 / np.arange(1, len(words) + 1)
    out = []
    for k in range(150):
        text = " ".join(rng.choice(words, rng.integers(0, 40), p=p / p.sum()))
        out.append((text, ["en", "de"][k % 2], "hot" if k % 3 else f"s{k % 7}"))
    return out + [(None, "en", "quiet"), ("", None, None), ("the the the", None, "a"), ("the", None, "b"), ("once", "fr", "alone"), *[("the same", "en", "hot")] * 5]


def collected(out):
    return {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in out.collect()}


def frame(spark, values):
    return spark.createDataFrame([(*v, "x", 1) for v in values], "text string, lang string, source string, term string, n int").repartition(5)


def test_against_plain_counts(spark):
    assert collected(divergence.audit(frame(spark, rows()))) == plain(rows())
    assert collected(divergence.audit(frame(spark, rows()), least=1, top=5)) == plain(rows(), 1, 5)


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 16)
    raw = np.frombuffer(("one two " * 20 + "x" * 70 + " Two").encode(), np.uint8)
    group, term, n, docs = divergence._counted_long(raw, 3)
    assert dict(zip(term.to_pylist(), n.tolist(), strict=True)) == {"one": 20, "two": 21, "x" * 70: 1} and set(group) == {3} and set(docs) == {1}


def test_empty_table_and_no_terms(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    alone = [("", "en", "a"), (None, "en", "b"), ("rare", "en", "c")]
    assert collected(divergence.audit(frame(spark, alone))) == plain(alone) and len(plain(alone)) == 6


def test_shares_are_exact():
    n = np.array([0, 5, 10**12, 9 * 10**14])
    total = np.array([7, 6, 3 * 10**12, 9 * 10**15])
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total, strict=True)]
