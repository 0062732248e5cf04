"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is cut into segments of at most 23 bits. The perfect binary Golay code decodes a 23-bit
word, and each word one bit away, to one codeword or to six; two words that differ in at most two bits
share one. With at most two differing bits in three segments, one segment agrees and its neighbour
differs in two bits at most, so a key of an exact segment and a codeword index of the next finds every
pair: three to eighteen keys a fingerprint.

Fingerprints are made distinct first, so copies never pair up. A small bucket's pairs are compared. In a
larger bucket each fingerprint is listed under itself and its 64 one-bit neighbours: two fingerprints
differ in at most two bits exactly if they share such a point, and at most 65 distinct fingerprints
share one, so a chain of links through each point costs a number of rows in proportion to the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import materialize, tidy
from loomfield.llm.components import components

#: Bits of the three segments of a 64-bit fingerprint, from the highest.
SEGMENTS = (22, 21, 21)
#: The generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b110001110101
#: Buckets of more distinct fingerprints than this are linked by their one-bit neighbours.
SMALL_BUCKET = 32
SEED = 42
_UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = 1 << 15


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in arrays of bounded length; a shorter text's whole sequence is one."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.translate(_UPPER_TO_LOWER).split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1], ends[k - 1 :]
    for i in range(0, len(starts), _RUN):
        pairs = zip(starts[i : i + _RUN].tolist(), ends[i : i + _RUN].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes; a text without words has 0."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint long) of every row's whole text; a null text has none of the words."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint((t.as_py() or "").encode(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], ["id", "fingerprint"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), f"id {kind}, fingerprint long")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each bit, and the error pattern of each syndrome: at most three bits."""
    bits = np.zeros(23, np.uint32)
    for i in range(23):
        rest = 1 << i
        for j in range(i, 10, -1):
            if rest >> j & 1:
                rest ^= GENERATOR << (j - 11)
        bits[i] = rest
    errors = np.zeros(2048, np.uint32)
    for i in range(23):
        errors[bits[i]] = 1 << i
        for j in range(i):
            errors[bits[i] ^ bits[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[bits[i] ^ bits[j] ^ bits[k]] = 1 << i | 1 << j | 1 << k
    return bits, errors


#: Plain arrays, so that they travel with the functions that use them.
_SYNDROMES = _golay()


def golay_indices(segment: np.ndarray) -> np.ndarray:
    """[n, 24] indices (12 bits) of the codewords nearest to each 23-bit word and its one-bit neighbours."""
    bits, errors = _SYNDROMES
    segment = segment.astype(np.uint32)
    syndrome = np.zeros(len(segment), np.uint32)
    for i in range(23):
        syndrome ^= np.where(segment >> np.uint32(i) & np.uint32(1), bits[i], np.uint32(0))
    out = np.empty((len(segment), 24), np.uint32)
    out[:, 23] = segment ^ errors[syndrome]
    for i in range(23):
        out[:, i] = segment ^ np.uint32(1 << i) ^ errors[syndrome ^ bits[i]]
    return out >> np.uint32(11)


def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of 64-bit fingerprints: an exact segment and an index of the next one."""
    values = values.astype(np.uint64)
    parts, low = [], 64
    for width in SEGMENTS:
        low -= width
        parts.append(values >> np.uint64(low) & np.uint64((1 << width) - 1))
    rows, keys = [], []
    for j, own in enumerate(parts):
        near = np.sort(golay_indices(parts[(j + 1) % len(parts)]), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(new)
        rows.append(row)
        keys.append(np.uint64(j) << np.uint64(40) | own[row] << np.uint64(12) | near[row, column].astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): enough links between distinct `fingerprint`s two or fewer bits apart to join all that are.

    Every pair of a small bucket that is near enough is a link; a large bucket gives each point's
    fingerprints a link to the least of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), 1 << 16):
                part = values[i : i + (1 << 16)]
                row, key = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[row])], ["key", "fp"])

    keys = materialize(distinct.select("fingerprint").mapInArrow(tidy(run), "key long, fp long"))
    sizes = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    small = keys.join(sizes.where(F.col("n") <= SMALL_BUCKET), "key").groupBy("key").agg(F.collect_list("fp").alias("all"))
    small = small.select(F.explode("all").alias("a"), "all")
    near = F.filter("all", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= 2))
    small = small.select("a", F.explode(near).alias("b"))
    large = keys.join(sizes.where(F.col("n") > SMALL_BUCKET), "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    points = large.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
    # At most 65 distinct fingerprints lie within one bit of a point.
    around = points.groupBy("point").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    around = around.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return small.unionByName(around).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Each row's id, `fingerprint` (16 hex digits) and `component_id`, the least id of its component.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and ids stay, and
    an id that is null never is the least unless all are. An empty table gives an empty one.
    """
    known = materialize(fingerprints(docs, id_col, text_col, words))
    distinct = materialize(known.groupBy("fingerprint").agg(F.min("id").alias("least")))
    joined = components(links(distinct))
    grouped = distinct.join(joined, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of = materialize(grouped.join(least, "component").select("fingerprint", "component_id"))
    return known.join(of, "fingerprint", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )
