"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting sums n-gram counts by language over every learning row; scoring gathers the broadcast
log-probability rows of a batch's n-grams in numpy and adds them up by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import blocks, by_row, code_points, text_buffer, text_parts, tidy

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: The model has languages x buckets numbers; more languages than this are refused.
MOST_LANGUAGES = 256
SMOOTHING = 0.5
_BLOCK = 1 << 18
_ODD = 2654435761  # an odd 32-bit multiplier


def ngrams(points: np.ndarray, bounds: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each code point, and a mask that is false where it leaves its row."""
    lower = points + np.where((points >= 65) & (points <= 90), 32, 0).astype(np.uint32)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    n = len(points)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(order):
        h *= np.uint32(0x01000193)
        h[: max(n - j, 0)] ^= lower[j:]
    h *= np.uint32(_ODD)
    return h >> np.uint32(32 - int(buckets).bit_length() + 1), np.arange(n) + order <= ends


def _parts(data, offsets: np.ndarray, orders: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, bounds, own) of a block of rows; a long row comes in parts, `own` code points of which start n-grams."""
    start, stop = int(offsets[0]), int(offsets[-1])
    if len(offsets) > 2 or stop - start <= 2 * _BLOCK:
        points, bounds = code_points(data[start:stop], offsets - start)
        yield points, bounds, len(points)
        return
    for a, own, end in text_parts(np.frombuffer(data[start:stop], np.uint8), _BLOCK, 4 * max(orders)):
        points, bounds = code_points(data[start + a : start + end], np.array([0, own - a, end - a]))
        yield points, bounds[[0, 2]], int(bounds[1])


def counts(docs: DataFrame, text_col: str, lang_col: str, orders: tuple = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n): n-gram counts by language, and at bucket -1 the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            langs = batch.column(1).to_pylist()
            for i, j in blocks(offsets, _BLOCK):
                names = langs[i:j]
                for name in names:
                    rows[name] = rows.get(name, 0) + 1
                known = sorted(set(names))
                for points, bounds, own in _parts(data, offsets[i : j + 1], orders):
                    code = np.repeat(np.searchsorted(known, names), np.diff(bounds))
                    for order in orders:
                        bucket, whole = ngrams(points, bounds, order, buckets)
                        whole[own:] = False
                        got = np.bincount((code * buckets + bucket)[whole], minlength=buckets * len(known))
                        for k, name in enumerate(known):
                            total.setdefault(name, np.zeros(buckets, np.int64))
                            total[name] += got[k * buckets : (k + 1) * buckets]
        for name, of in total.items():
            at = np.flatnonzero(of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(at) + 1), pa.string()),
                    pa.array(np.append(at, -1).astype(np.int32)),
                    pa.array(np.append(of[at], rows[name])),
                ],
                ["lang", "bucket", "n"],
            )

    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(lang_col).cast("string"))
    rows = rows.where(F.col(lang_col).isNotNull())
    partial = rows.mapInArrow(tidy(run), "lang string, bucket int, n long")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(learn: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: tuple = ORDERS, buckets: int = BUCKETS):
    """(languages, log-probability matrix [bucket, language], log priors).

    Covers every row of `learn` with a language. Ties go to the first language by name. The matrix is
    collected: buckets x languages numbers, whatever the number of rows.
    """
    got = counts(learn, text_col, lang_col, orders, buckets).toPandas()
    langs = sorted(got["lang"].unique())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model takes {MOST_LANGUAGES} at most")
    table = np.zeros((buckets, len(langs)))
    prior = np.zeros(len(langs))
    for k, name in enumerate(langs):
        own = got[got["lang"] == name]
        rows = own["bucket"] < 0
        prior[k] = own.loc[rows, "n"].sum()
        table[own.loc[~rows, "bucket"], k] = own.loc[~rows, "n"]
    table += SMOOTHING
    table = np.log(table) - np.log(table.sum(axis=0))
    return langs, table.astype(np.float32), np.log(np.maximum(prior, 1e-9)) - np.log(max(prior.sum(), 1e-9))


def predict(
    docs: DataFrame,
    model,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: dict[str, Column] | None = None,
    orders: tuple = ORDERS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Each row's `id_col`, the `keep` columns, `lang_pred` and `score`.

    `score` is the predicted language's share of the posterior, tempered by the number of n-grams so
    that it does not run to 1 on any long text. A null text, or one without a letter (Unicode category
    L), is `und` with score 0, and so is all if nothing was learned. Rows stay as they are, repeated
    ones too. A map without a shuffle.
    """
    langs, table, prior = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, table, prior))
    names = list(keep or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, first = shared.value
        width = len(known)
        for batch in batches:
            data, offsets = text_buffer(batch.column("_text"))
            letters = np.array(batch.column("_letters").to_pylist(), bool)
            best, score = np.zeros(len(letters), np.int64), np.zeros(len(letters))
            for i, j in blocks(offsets, _BLOCK) if width else ():
                sums, seen = np.zeros((j - i, width)), np.zeros(j - i)
                for points, bounds, own in _parts(data, offsets[i : j + 1], orders):
                    for order in orders:
                        bucket, whole = ngrams(points, bounds, order, buckets)
                        whole[own:] = False
                        for k in range(width):
                            sums[:, k] += by_row(np.where(whole, logs[bucket, k], np.float32(0)), bounds)
                        seen += by_row(whole, bounds)
                total = first + sums / np.sqrt(np.maximum(seen, 1))[:, None]
                best[i:j] = (first + sums).argmax(axis=1)
                share = np.exp(total - total.max(axis=1, keepdims=True))
                score[i:j] = (share / share.sum(axis=1, keepdims=True))[np.arange(j - i), best[i:j]]
            found = [known[k] if ok and width else "und" for k, ok in zip(best, letters)]
            score[~letters] = 0.0
            out = [batch.column(c) for c in (id_col, *names)]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(found, pa.string()), pa.array(score)], [id_col, *names, "lang_pred", "score"]
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col), *[c.alias(n) for n, c in (keep or {}).items()], text.alias("_text"), text.rlike(r"\p{L}").alias("_letters")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: 1 + len(names)])
    return rows.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double")
