"""SimHash against a brute-force version, and the Golay keys against all pairs."""

import random

import numpy as np
import xxhash

from loomfield.llm import simhash
from loomfield.llm.components import components


def brute_fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = lower.encode().split()
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if hashes and 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if bin(a ^ b).count("1") <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_golay_words_two_bits_apart_share_an_index():
    rng = random.Random(3)
    for _ in range(300):
        word = rng.getrandbits(23)
        other = word ^ sum(1 << b for b in rng.sample(range(23), rng.choice([0, 1, 2])))
        a, b = simhash.golay_indices(np.array([word, other]))
        assert set(a.tolist()) & set(b.tolist())
        assert len(set(a.tolist())) in (1, 6)


def test_fingerprint_is_that_of_the_definition():
    for text in ["", " \t\n", "One", "one TWO", "É one two three four " * 9, "a b c " * 50, "x y z w"]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_rows_with_nulls_copies_and_extra_columns(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(30)) for _ in range(n)) for n in (1, 2, 3, 40, 300)]
    texts = [*base, *base[:2], base[3] + " more", base[4].upper(), None, "", "  \n", base[4] + " tail"]
    rows = [(i, t, "key") for i, t in enumerate(texts)] + [(3, base[3], "key"), (None, "lost", "key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    least = brute_components(prints)
    want = [(i, f"{brute_fingerprint(t):016x}", least[i] if i is not None else None) for i, t, _ in rows]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_links_join_what_brute_force_joins_in_a_large_bucket(spark):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3]))) for s in seeds for _ in range(150)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    edges = simhash.links(table).collect()
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = brute_components({p: p & (1 << 64) - 1 for p in signed})
    groups = lambda of: {frozenset(p for p in signed if of.get(p, p) == c) for c in {of.get(p, p) for p in signed}}
    assert groups(got) == groups(least)


def test_long_chain_is_one_component(spark):
    chain = spark.range(500).selectExpr("id as a", "id + 1 as b").union(spark.range(3).selectExpr("id + 900", "id + 900"))
    got = components(chain).collect()
    assert len(got) == 501 and {r.component for r in got} == {0}
