"""Source divergence audit: how each source of a language differs from the others, and by which terms.

Terms that each source uses equally often have the same counts in every source, so they add the same to every comparison. The
terms of a language are grouped by their sparse vector of counts by source; each distinct vector is compared once for every pair
of sources and once with the language as a whole, and what it gives is multiplied by the number of its terms. Only the best
vectors of a source are turned back into terms, which are then ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.common import blocks, materialize, text_buffer, tidy

#: Parts of a source's tokens are counted in units of this.
SCALE = 1_000_000_000
LEAST_DOCUMENTS, TOP = 3, 200
#: Bytes of text that are counted at once, and cells of a block of vectors.
BLOCK, CELLS = 1 << 23, 1 << 20

# Bytes of terms, A-Z in lower case; any other byte becomes a blank.
_TERM = np.full(256, 0x20, np.uint8)
_TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERM[0x80:] = np.arange(0x80, 0x100)


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row and term of each occurrence in the rows that `bounds` cut from UTF-8 bytes."""
    ends = pa.array(bounds, pa.int64())
    clean = pa.LargeStringArray.from_buffers(len(bounds) - 1, ends.buffers()[1], pa.py_buffer(_TERM[raw]))
    split = pc.ascii_split_whitespace(clean)
    words = split.flatten().cast(pa.string())
    some = pc.not_equal(words, "")
    return np.asarray(pc.list_parent_indices(split).filter(some)).astype(np.int64), words.filter(some).dictionary_encode()


def _counted(raw: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, rows) of a block of rows."""
    row, words = _words(raw, bounds)
    n_terms = max(1, len(words.dictionary))
    in_row, n = np.unique(row * n_terms + np.asarray(words.indices), return_counts=True)
    key, of = np.unique(group[in_row // n_terms] * n_terms + in_row % n_terms, return_inverse=True)
    rows = np.bincount(of, minlength=len(key)).astype(np.int64)
    return key // n_terms, words.dictionary.take(pa.array(key % n_terms)), np.bincount(of, n, len(key)).astype(np.int64), rows


def _counted_long(raw: np.ndarray, group: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The same of one long text, in parts that end between two terms; a part without such a place is read with the next."""
    total: dict[str, int] = {}
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + BLOCK)
        while stop < len(raw) and _TERM[raw[stop - 1]] != 0x20:
            gap = np.flatnonzero(_TERM[raw[stop : stop + BLOCK]] == 0x20)
            stop = stop + int(gap[0]) + 1 if len(gap) else min(len(raw), stop + BLOCK)
        _, terms, n, _ = _counted(raw[at:stop], np.array([0, stop - at]), np.zeros(1, np.int64))
        for term, count in zip(terms.to_pylist(), n.tolist(), strict=True):
            total[term] = total.get(term, 0) + count
        at = stop
    return np.full(len(total), group), pa.array(total, pa.string()), np.array(list(total.values()), np.int64), np.ones(len(total), np.int64)


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a map in Arrow batches adds up blocks of rows before the shuffle."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column(2))
            raw = np.frombuffer(data, np.uint8)
            number: dict[tuple, int] = {}
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            group = np.array([number.setdefault(p, len(number)) for p in pairs], np.int64)
            lang, source = (pa.array([p[k] for p in number], pa.string()) for k in (0, 1))
            for start, end in blocks(bounds, BLOCK):
                own = raw[bounds[start] : bounds[end]]
                if len(own) > 2 * BLOCK:
                    of, term, n, rows = _counted_long(own, group[start])
                else:
                    of, term, n, rows = _counted(own, bounds[start : end + 1] - bounds[start], group[start:end])
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(of)), source.take(pa.array(of)), term, pa.array(n), pa.array(rows)], names)

    rows = _filled(docs, lang=lang_col, source=source_col, text=text_col)
    mapped = rows.mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")
    return mapped.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _filled(docs: DataFrame, **columns: str) -> DataFrame:
    """Columns of `docs` under new names, as strings without nulls."""
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for name, c in columns.items()])


def shares(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exactly: three digits of the quotient at a time, for totals up to 9e15."""
    left, out = (n + 1).astype(np.int64), np.zeros(np.broadcast(n, total).shape, np.int64)
    whole, left = left // np.maximum(total, 1), left % np.maximum(total, 1)
    out += whole
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // np.maximum(total, 1)
        left = left % np.maximum(total, 1)
    return 1 + out


def _pair_sums(vectors: DataFrame, langs: dict[str, tuple[list[str], np.ndarray, int]]) -> DataFrame:
    """(lang, source, item, value): each task adds up its distinct vectors for every two sources, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: {s: k for k, s in enumerate(sources)} for lang, (sources, _, _) in langs.items()}
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang_of = batch.column(0).dictionary_encode()
            code, held = np.asarray(lang_of.indices), batch.column(1)
            ends, flat = np.asarray(held.offsets).astype(np.int64), held.values
            names, counts, weight = flat.field(0), np.asarray(flat.field(1)), np.asarray(batch.column(2))
            for k, lang in enumerate(lang_of.dictionary.to_pylist()):
                sources, totals, kept = langs[lang]
                known = names.dictionary_encode()
                column = np.array([place[lang].get(s, -1) for s in known.dictionary.to_pylist()], np.int64)[np.asarray(known.indices)]
                rows = np.flatnonzero(code == k)
                acc = sums.setdefault(lang, np.zeros((len(sources), len(sources)), np.int64))
                step = max(1, CELLS // len(sources))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    size = ends[some + 1] - ends[some]
                    entry = np.repeat(ends[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    dense = np.zeros((len(some), len(sources)), np.int64)
                    dense[np.repeat(np.arange(len(some)), size), column[entry]] = counts[entry]
                    p = shares(dense, totals[None, :] + kept)
                    for g in range(len(sources)):
                        apart = p[:, g : g + 1] - p
                        acc[g] += (weight[some][:, None] * (apart * apart // p)).sum(axis=0)
        for lang, acc in sums.items():
            sources = pa.array(langs[lang][0], pa.string())
            for g in range(len(sources)):
                others = np.delete(np.arange(len(sources)), g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(others), pa.string()), pa.array([langs[lang][0][g]] * len(others), pa.string()), sources.take(pa.array(others)), pa.array(acc[g][others])],
                    ["lang", "source", "item", "value"],
                )

    out = vectors.select("lang", "vector", "terms").mapInArrow(tidy(run), "lang string, source string, item string, value long")
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(n: Column, total: Column) -> Column:
    whole = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", whole(n + 1) * F.lit(SCALE), whole(total))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank) for each language and source.

    Part `pair`: each other source of the language, by the sum over kept terms of floor((p - q)^2 / q); part `term`: the `top` kept
    terms that the source has and uses more than its language does. p and q are `shares` of the source's and the other's counts.
    A language keeps the terms in `least` of its documents. Null and empty texts have no term, null languages and sources count
    as ''; repeated rows count each; a source without terms is compared too; an empty table gives no row; other columns aren't
    read. Hot terms and sources are summed before any shuffle. On the driver is one row a language and source, of which the
    result has one for every two.
    """
    groups = materialize(_filled(docs, lang=lang_col, source=source_col).distinct())
    counts = term_counts(docs, text_col, lang_col, source_col)
    held = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    kept = materialize(held.where(F.col("docs") >= least).select("lang", "term", "vector"))
    vectors = materialize(kept.groupBy("lang", "vector").agg(F.count("*").alias("terms")))

    used = vectors.select("lang", "terms", F.explode("vector").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("e.n") * F.col("terms")).alias("tokens"))
    sizes = vectors.groupBy("lang").agg(F.sum("terms").alias("kept"))
    totals = groups.join(used, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["tokens", "kept"])
    totals = materialize(totals)
    langs: dict[str, tuple[list[str], np.ndarray, int]] = {}
    for r in totals.groupBy("lang", "kept").agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("s")).collect():
        langs[r["lang"]] = ([x["source"] for x in r["s"]], np.array([x["tokens"] for x in r["s"]], np.int64), r["kept"])

    blank = totals.where("kept = 0").select("lang", "source")
    none = blank.join(blank.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = _pair_sums(vectors, langs).unionByName(none).withColumn("part", F.lit("pair"))

    of_lang = totals.groupBy("lang").agg(F.sum("tokens").alias("lang_tokens"))
    n_all = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    entries = vectors.select("lang", "vector", n_all.alias("n_all"), F.explode("vector").alias("e")).select("*", F.col("e.source").alias("source"))
    entries = entries.join(totals, ["lang", "source"]).join(of_lang, "lang")
    p, q = _share(F.col("e.n"), F.col("tokens") + F.col("kept")), _share(F.col("n_all"), F.col("lang_tokens") + F.col("kept"))
    entries = entries.select("lang", "source", "vector", p.alias("p"), q.alias("q")).where("p > q")
    entries = entries.select("lang", "source", "vector", F.expr("(p - q) * (p - q) div q").alias("value"))
    by_source = Window.partitionBy("lang", "source")
    best = entries.withColumn("_r", F.rank().over(by_source.orderBy(F.desc("value")))).where(F.col("_r") <= top).drop("_r")
    terms = best.join(kept, ["lang", "vector"]).select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    order = by_source.orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(terms.select(*columns))
