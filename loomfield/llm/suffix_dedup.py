"""Suffix-array deduplication of long byte strings, by threshold-bounded interval expansion on a BWT.

1. A text's windows of `least` bytes are grouped into pieces: runs of windows with one minimizer (the
   least hash of the k-grams inside). Equal windows have equal minimizers wherever they are, so a
   minimizer's pieces hold all the places of each of its windows.
2. Pieces whose minimizer no other piece has, and which hold it once, repeat nothing. Equal pieces
   become one with a count; if a minimizer has one distinct piece, its count decides.
3. The other minimizers' distinct pieces are fetched and dealt out by minimizer. A block of them gets a
   suffix array ordered by its first bytes (prefix doubling up to the threshold), the Burrows-Wheeler
   transform of that, and a breadth-first backward extension: the intervals of all strings of length 0,
   1, 2, ... yield the common prefixes of neighbouring suffixes by increasing value, and it stops at the
   threshold. Neighbours whose value was never reached share `least` bytes; a class of such windows with
   a count of two or more repeats.
4. Windows go back to their texts as byte ranges, whose union is removed.

A minimizer with very many distinct pieces (a common phrase in ever other surroundings) would be one
block without bound, so it is dealt out once more, window by window, with windows counted by hash; that
path is exact too and is only taken above HOT_PIECES.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import blocks, materialize, text_buffer

LEAST = 200
GRAM = 32
#: Bytes of a scan block, and of the pieces in one transform.
SCAN_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20
HOT_PIECES = 20_000
#: Bits of the filter that tells which texts to fetch: 2 MB, whatever the input.
FILTER_BITS = 24
#: Ends a piece; UTF-8 has no such byte, and it sorts after all others.
END = 0xFF
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Tables that a task has made; functools.cache would be pickled by reference, and executors have no copy of the package.
_MADE: dict = {}


def _bytes_table(seed: int) -> np.ndarray:
    if ("bytes", seed) not in _MADE:
        _MADE["bytes", seed] = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64)
    return _MADE["bytes", seed]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if ("powers", size) not in _MADE:
        one = np.ones(1, np.uint64)
        _MADE["powers", size] = tuple(np.concatenate([one, np.cumprod(np.full(size, base))]) for base in (_BASE, _BACK))
    return _MADE["powers", size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _grams(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes (a power of two) from each place; the last places' are of no use."""
    h, power, step = values, _BASE, 1
    while step < size:
        nxt = h * power
        nxt[:-step] += h[step:]
        h, power, step = nxt, power * power, step * 2
    return _mixed(h)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of `width` values from each place (shorter at the end)."""
    op, step, out = (np.minimum if least else np.maximum), 1, values
    while step * 2 <= width:
        nxt = out.copy()
        nxt[:-step] = op(out[:-step], out[step:])
        out, step = nxt, step * 2
    if rest := width - step:
        nxt = out.copy()
        nxt[:-rest] = op(out[:-rest], out[rest:])
        out = nxt
    return out


def pieces(data: np.ndarray, bounds: np.ndarray, least: int = LEAST, gram: int = GRAM):
    """(row, start, length, minimizer, hash, whether the minimizer occurs in it more than once) of each piece."""
    n, none = len(data), np.zeros(0, np.int64)
    sizes = np.diff(bounds)
    if n < least or sizes.max() < least:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    with np.errstate(over="ignore"):
        values = _bytes_table(1)[data]
        grams = _grams(values, gram)
        width = least - gram + 1
        low = _sliding(grams, width, True)
        valid = np.arange(n) + least <= np.repeat(bounds[1:], sizes)
        low[~valid] = 0
        change = np.ones(n, bool)
        change[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
        start = np.flatnonzero(valid & change)
        final = np.ones(n, bool)
        final[:-1] = change[1:] | ~valid[1:]
        stop = np.flatnonzero(valid & final) + least
        key = low[start]
        power, inverse = _powers(1 << max(20, int(n).bit_length()))
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_bytes_table(2)[data] * power[:n])])
        digest = _mixed((running[stop] - running[start]) * inverse[start])
        # A place holds a minimizer if its hash is that of some window around it.
        behind = np.zeros_like(low)
        behind[: n] = _sliding(low[::-1], width, False)[::-1]
        held = np.flatnonzero(grams == behind)
        first, last = np.searchsorted(held, start), np.searchsorted(held, stop - gram, side="right")
        own = np.repeat(np.arange(len(start)), last - first)
        place = held[np.arange(len(own)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)]
        times = np.bincount(own[grams[place] == key[own]], minlength=len(start))
    row = np.searchsorted(bounds, start, side="right") - 1
    return row, start - bounds[row], stop - start, key, digest, times > 1


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the `depth` or more bytes from each, by prefix doubling; equal ones in any order."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    done = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        if done >= depth or fresh.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh)
        key = rank << np.uint64(32)
        key[: max(0, n - done)] |= rank[done:]
        done *= 2


def common_prefix_bounds(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """True at i where suffixes i - 1 and i of the order share fewer than `least` bytes (END never counts as shared).

    Breadth-first backward extension: the queue holds the intervals of some strings of one length. Each
    is extended by every byte before its suffixes; an interval whose end has no value yet gets the
    length as its value and joins the next queue.
    """
    n = len(text)
    before = text[order - 1]  # the first place has the last byte, an END, before it
    mapped = np.empty(n, np.int64)
    by_byte = np.argsort(before, kind="stable")
    mapped[by_byte] = np.arange(n)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    following, preceding = np.full(n, n), np.full(n, -1)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    preceding[by_byte[1:][same]] = by_byte[:-1][same]
    inner = before != END
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        size = high - low
        at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        ok = inner[at]
        opens = at[ok & (preceding[at] < np.repeat(low, size))]
        closes = at[ok & (following[at] >= np.repeat(high, size))]
        low, high = np.sort(mapped[opens]), np.sort(mapped[closes]) + 1
        new = ~known[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        known[high] = True
    return known[:n]


def repeated_windows(texts: list[bytes], counts: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """For each text, the (start, end) byte ranges of its windows that occur twice or more; texts count `counts` times."""
    joined = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes) - 1
    order = suffix_order(joined, least)
    group = np.cumsum(common_prefix_bounds(joined, order, least))
    place = np.arange(len(joined))
    owner = np.repeat(np.arange(len(texts)), sizes)
    valid = place + least <= ends[owner]
    kept = valid[order]
    total = np.bincount(group[kept], weights=counts[owner[order[kept]]], minlength=int(group[-1]) + 1)
    again = np.zeros(len(joined), bool)
    again[order[kept]] = total[group[kept]] >= 2
    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + least
    whose = owner[start] if len(start) else start
    first = ends - sizes + 1
    cuts = np.searchsorted(whose, np.arange(len(texts) + 1))
    return [np.stack([start[a:b], stop[a:b]], 1) - first[k] for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def _pack(ranges: np.ndarray) -> np.ndarray:
    return ranges[:, 0].astype(np.int64) << 32 | ranges[:, 1].astype(np.int64)


def _scan(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column(1))
            raw = np.frombuffer(data, np.uint8)
            for i, j in blocks(offsets, SCAN_BYTES):
                row, start, size, key, digest, multi = pieces(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least)
                if len(row):
                    columns = [ids[i:j][row], start.astype(np.int32), size.astype(np.int32), key.view(np.int64), digest.view(np.int64), multi]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["row", "start", "size", "key", "digest", "multi"])

    return docs.mapInArrow(run, "row long, start int, size int, key long, digest long, multi boolean")


def _wanted(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `docs` that a filter of fixed size lets through: all that `rows` names and few others."""
    bit = F.col("row").bitwiseAND((1 << FILTER_BITS) - 1)
    words = rows.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(row & 63 AS int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) & ((1 << FILTER_BITS) - 1)
            keep = shared.value[at >> 6] >> (at & 63) & 1
            yield batch.filter(pa.array(keep.astype(bool)))

    return docs.mapInArrow(run, docs.schema)


def _transform(fetched: DataFrame, least: int) -> DataFrame:
    """(key, digest, ranges) of distinct pieces (key, digest, n, piece), blocks of whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            found = repeated_windows([x[3] for x in held], np.array([min(x[2], 2) for x in held]), least)
            columns = [[x[0] for x in held], [x[1] for x in held], [_pack(r) for r in found]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], ["key", "digest", "ranges"])

        for batch in batches:
            for item in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= BLOCK_BYTES and item[0] != held[-1][0]:
                    yield close()
                    size = 0
                held.append(item)
                size += len(item[3]) + 1
        if held:
            yield close()

    return fetched.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, digest long, ranges array<long>")


def _by_window(fetched: DataFrame, least: int) -> DataFrame:
    """As _transform, for keys with very many pieces: windows are dealt out and counted by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digest, n, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = np.frombuffer(piece, np.uint8)
                with np.errstate(over="ignore"):
                    power, inverse = _powers(1 << max(20, len(raw).bit_length()))
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_bytes_table(s)[raw] * power[: len(raw)])]) for s in (3, 4)]
                    a, b = (_mixed((s[least:] - s[:-least]) * inverse[: len(raw) - least + 1]).view(np.int64) for s in sums)
                m = len(a)
                columns = [np.full(m, key), np.full(m, digest), np.full(m, min(n, 2)), np.arange(m), a, b]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "digest", "n", "at", "a", "b"])

    windows = materialize(fetched.mapInArrow(run, "key long, digest long, n long, at long, a long, b long"))
    often = materialize(windows.groupBy("a", "b").agg(F.sum("n").alias("total")).where("total > 1").select("a", "b"))
    pack = F.expr("at * 4294967296 + at") + least
    return windows.join(often, ["a", "b"]).groupBy("key", "digest").agg(F.collect_list(pack).alias("ranges"))


def _kept(ids_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ranges = batch.column(2)
            sizes, removed, spans, sums = [], [], [], []
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                got = ranges[k].values
                digest, at, runs, lost = hashlib.sha256(), 0, 0, 0
                end = -1
                for packed in np.sort(got.to_numpy(zero_copy_only=False)) if got is not None and len(got) else ():
                    a, b = int(packed) >> 32, int(packed) & 0xFFFFFFFF
                    if a > end:
                        digest.update(text[at:a])
                        runs += 1
                    if b > end:
                        lost += b - max(a, end)
                        end = at = b
                digest.update(text[at:])
                sizes.append(len(text))
                removed.append(lost)
                spans.append(runs)
                sums.append(digest.hexdigest())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run, f"id {ids_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def ranges(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, ranges): byte ranges, packed as start << 32 | end, of `docs` (row long, text) that repeat somewhere.

    Ranges of a row may overlap. Rows without any are not returned. A row that occurs twice repeats itself.
    """
    places = materialize(_scan(docs, least))
    by_key = places.groupBy("key").agg(
        F.count("*").alias("n"), (F.min("digest") == F.max("digest")).alias("alike"), F.max("multi").alias("looped")
    )
    by_key = by_key.where("n > 1 or looped").withColumn("settled", F.col("alike") & ~F.col("looped"))
    places = materialize(places.join(by_key.select("key", "settled"), "key").drop("multi"))
    distinct = places.where("not settled").groupBy("key", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "start", "size")).alias("at")
    )
    distinct = materialize(distinct.select("key", "digest", "n", "at.*"))
    hot = materialize(distinct.groupBy("key").agg(F.count("*").alias("pieces")).where(F.col("pieces") > HOT_PIECES))
    texts = _wanted(docs, distinct).dropDuplicates(["row"])
    piece = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("size"))
    fetched = materialize(distinct.join(texts, "row").select("key", "digest", "n", piece.alias("piece")))
    verdicts = _transform(fetched.join(hot, "key", "left_anti"), least)
    if not hot.isEmpty():
        verdicts = verdicts.unionByName(_by_window(fetched.join(hot, "key", "left_semi"), least))
    verdicts = materialize(verdicts.where(F.size("ranges") > 0))
    whole = F.expr("start * 4294967296 + start") + F.col("size")
    settled = places.where("settled").select("row", F.array(whole).alias("part"))
    moved = F.transform("ranges", lambda r: r + F.expr("start * 4294967296 + start"))
    others = places.where("not settled").join(verdicts, ["key", "digest"]).select("row", moved.alias("part"))
    return settled.unionByName(others).groupBy("row").agg(F.flatten(F.collect_list("part")).alias("ranges"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Each row's id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256, of the remaining bytes.

    Removed is each byte that a string of `least` bytes covers which also starts anywhere else, in the
    same text or another, as the input stands. Null and empty texts have nothing to remove. Rows that
    repeat stay, and as two texts they repeat each other.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.col("id").cast("string"), "text"))
    found = materialize(ranges(rows.select("row", "text"), least))
    joined = rows.join(found, "row", "left").select("id", "text", "ranges")
    run, schema = _kept(rows.schema["id"].dataType.simpleString())
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
