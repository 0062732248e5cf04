"""Quality classifier: supervised subword embeddings.

Hashed words and character n-grams have learned vectors; a document is the average of its vectors, and
a softmax layer gives its class. Trained on the driver by stochastic gradient descent in numpy, on a
bounded sample of labelled rows. The output is linear in the average, so scoring folds vectors and
layer into one number a bucket, which is broadcast (buckets x 4 bytes, whatever the corpus).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import blocks, by_row, code_points, text_buffer, text_parts, tidy

BUCKETS = 1 << 18
ORDERS = (3, 4, 5)
DIM = 8
EPOCHS = 4
RATE = 4.0
#: Labelled rows of each class to learn from, the first by a hash of the id, and their bytes in all.
SAMPLE_PER_CLASS = 2000
SAMPLE_BYTES = 24 << 20
_BLOCK = 1 << 17


def features(points: np.ndarray, bounds: np.ndarray, orders: tuple, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, code point at which it starts) of every feature of some rows.

    Character n-grams lie within a word and the white space beside it, which marks its ends. A word is a
    feature, and a word that equals the one before it is one feature, whatever the word.
    """
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.repeat(bounds[1:], np.diff(bounds))
    flat = np.where(space, 32, points).astype(np.uint32)
    blanks = np.concatenate([[0], np.cumsum(space)])
    n = len(points)
    at = np.arange(n)
    h = np.zeros(n, np.uint32)
    for order in range(1, max(orders) + 1):
        h *= np.uint32(0x01000193)
        h[: max(n - order + 1, 0)] ^= flat[order - 1 :]
        if order in orders:
            inner = blanks[np.minimum(at + order - 1, n)] - blanks[np.minimum(at + 1, n)]
            ok = (inner == 0) & (at + order <= ends)
            yield ((h[ok] + np.uint32(order * 7919)) * np.uint32(2654435761)) >> shift, at[ok]
    head = ~space
    if n:
        head[1:] &= space[:-1]
        head[bounds[:-1][bounds[:-1] < n]] |= ~space[bounds[:-1][bounds[:-1] < n]]
    start = np.flatnonzero(head)
    if not len(start):
        return
    row = np.searchsorted(bounds, start, side="right") - 1
    # A word's hash is the difference of a running sum, freed of its place by the powers' inverse.
    base, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    with np.errstate(over="ignore"):
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base))])
        running = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:-1] * ~space)])
        inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, back))])
        stop = np.append(start[1:], n)
        stop = np.minimum(stop, bounds[row + 1])
        word = (running[stop] - running[start]) * inverse[start]
        word = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    again = np.zeros(len(start), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    yield (word >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.uint32), start
    yield np.full(int(again.sum()), 1, np.uint32), start[again]


def _block_features(data, offsets: np.ndarray, orders: tuple, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, code points, row bounds) of the features of a block of rows; a long row is read in parts."""
    start, stop = int(offsets[0]), int(offsets[-1])
    if len(offsets) > 2 or stop - start <= 2 * _BLOCK:
        points, bounds = code_points(data[start:stop], offsets - start)
        yield from ((b, at, bounds) for b, at in features(points, bounds, orders, buckets))
        return
    for a, own, end in text_parts(np.frombuffer(data[start:stop], np.uint8), _BLOCK, 4 * max(orders)):
        points, bounds = code_points(data[start + a : start + end], np.array([0, own - a, end - a]))
        # What lies ahead belongs to the part's row as far as n-grams go, but starts no feature of it.
        for bucket, at in features(points, bounds[[0, 2]], orders, buckets):
            yield bucket, at, bounds[:2]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, size: int) -> list[tuple[str, int]]:
    """At most `rows` labelled texts of each class and `size` bytes in all, in the order of a hash of the id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label")).withColumn("_order", F.xxhash64(id_col))
    picked = [known.where(F.col("_label") == k).orderBy("_order", id_col).limit(rows) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    texts = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # ids has 2 x rows rows at most, so it is small enough to send to every executor.
    joined = texts.join(F.broadcast(ids), id_col)
    sizes = [(r["_order"], r[id_col], r["n"]) for r in joined.select("_order", id_col, F.octet_length("_text").alias("n")).collect()]
    last, total = None, 0
    for order, key, n in sorted(sizes):
        total += n
        if total > size and last is not None:
            break
        last = (order, key)
    if last is None:
        return []
    within = joined.where((F.col("_order") < last[0]) | ((F.col("_order") == last[0]) & (F.col(id_col) <= F.lit(last[1]))))
    got = within.select("_order", "_text", "_label").collect()
    return [(r["_text"], r["_label"]) for r in sorted(got, key=lambda r: (r["_order"], r["_text"]))]


def train(
    rows: list[tuple[str, int]], orders: tuple = ORDERS, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7
) -> tuple[np.ndarray, float]:
    """(a number for each bucket, an intercept): their average and sum are the log-odds of label 1.

    Classes weigh the same. Without rows of both classes the score is that of the class seen, or 0.5.
    """
    share = [sum(1 for _, label in rows if label == k) for k in (0, 1)]
    if not all(share):
        return np.zeros(buckets, np.float32), 0.0 if not any(share) else (3.0 if share[1] else -3.0)
    # Three flat arrays for all rows: they go back to the host at once when training is done.
    ids, counts, ends = [], [], [0]
    for text, _ in rows:
        points, bounds = code_points(text.encode(), np.array([0, len(text.encode())]))
        parts = [b for b, _ in features(points, bounds, orders, buckets)]
        own, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint32), np.zeros(0, int))
        ids.append(own.astype(np.uint32))
        counts.append(n.astype(np.uint32))
        ends.append(ends[-1] + len(own))
    all_ids, all_counts = np.concatenate(ids), np.concatenate(counts)
    del ids, counts
    weight = [len(rows) / (2 * n) for n in share]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = rng.uniform(-0.5, 0.5, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, part, label = all_ids[ends[k] : ends[k + 1]], all_counts[ends[k] : ends[k + 1]], rows[k][1]
            part = (part / max(1, part.sum())).astype(np.float32)
            now = rate * (1 - done / steps)
            done += 1
            mean = part @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= weight[label]
            back = p @ layer
            layer -= 0.1 * now * np.outer(p, mean)
            bias -= 0.01 * now * p
            if len(ids):
                # A bucket's share in the average is small; the step is scaled to the number of buckets.
                vectors[ids] -= now * np.sqrt(len(ids)) * part[:, None] * back
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def score(
    docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None, orders: tuple = ORDERS
) -> DataFrame:
    """Each row's `keep` columns, `score` (0 to 1, of label 1) and `predicted`.

    Null and empty texts have the intercept's score. Repeated rows stay. A map without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = {id_col: F.col(id_col)} if keep is None else keep
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, intercept = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(names)))
            odds = np.full(batch.num_rows, intercept)
            for i, j in blocks(offsets, _BLOCK):
                sums, seen = np.zeros(j - i), np.zeros(j - i)
                for bucket, at, bounds in _block_features(data, offsets[i : j + 1], orders, len(table)):
                    cuts = np.searchsorted(at, bounds)
                    sums += by_row(table[bucket], cuts)
                    seen += np.diff(cuts)
                odds[i:j] += sums / np.maximum(seen, 1)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            out = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"]
            )

    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_scored_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(names)])
    return rows.mapInArrow(tidy(run), f"{fields}, score double, predicted int")
