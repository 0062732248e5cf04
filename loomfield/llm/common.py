"""Shared pieces: scratch tables, Arrow text buffers, labelled splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_written: dict[str, SparkSession] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder that `spark.checkpoint.dir` names.

    Where the session names none (tests on one machine), a temporary folder is set for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="loomfield-")
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read again.

    It cuts lineage, survives lost executors, and gives the planner a file size to choose joins by.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that `materialize` wrote and that nothing will read again."""
    for table in tables:
        for name in {n.rpartition("/")[0] for n in table.inputFiles()}:
            for path in [p for p in _written if p.rpartition("/")[2] == name.rpartition("/")[2]]:
                remove(_written.pop(path), path)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone at exit; the cluster's own cleaning applies then
            return


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the fixed split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def text_buffer(column: pa.Array) -> tuple[bytes | memoryview, np.ndarray]:
    """UTF-8 bytes of a text column, end to end, and its n + 1 offsets; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if data is None or not len(at):
        return b"", np.zeros(len(column) + 1, np.int64)
    return memoryview(data)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def code_points(data: bytes | memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of whole rows, and the rows' offsets counted in code points."""
    points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
    return points, heads[offsets]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: Bytes that are hashed at once.
PART = 1 << 20


def word_hashes(raw: np.ndarray, bounds: np.ndarray, inside: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of some rows' bytes, and the rows' offsets counted in words.

    A word is a run of bytes that `inside` (256 booleans) marks; `value` (256 numbers) is equal for bytes that count as
    equal. A long row is read in parts that end where no word goes on; a word alone is never cut.
    """
    found, at = [], 0
    while at < len(raw):
        end = at + PART
        if end < len(raw):
            gap = np.flatnonzero(~inside[raw[at:end]])
            while not len(gap) and end < len(raw):
                gap = np.flatnonzero(~inside[raw[end : end + PART]]) + (end - at)
                end += PART
            end = at + int(gap[-1]) + 1 if len(gap) else len(raw)
        end = min(end, len(raw))
        cuts = bounds[(bounds > at) & (bounds < end)] - at
        start, h = _hashed(raw[at:end], cuts, inside, value)
        found.append((start + at, h))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    start, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, np.searchsorted(start, bounds)


def _hashed(raw: np.ndarray, cuts: np.ndarray, inside: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; words end at `cuts` too. A hash is the difference of a running sum, freed of its
    place by the powers' inverse."""
    n = len(raw)
    within = np.zeros(n + 2, bool)
    within[1:-1] = inside[raw]
    head = within[1:-1] & ~within[:-2]
    head[cuts] = within[1:-1][cuts]
    start = np.flatnonzero(head)
    tail = within[1:-1] & ~within[2:]
    tail[cuts - 1] = within[1:-1][cuts - 1]
    stop = np.flatnonzero(tail) + 1
    with np.errstate(over="ignore"):
        power, inverse = np.full(n + 1, _BASE), np.full(n + 1, _BACK)
        power[0] = inverse[0] = 1
        power, inverse = np.cumprod(power), np.cumprod(inverse)
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(value[raw] * power[:n], out=running[1:])
        return start, mixed((running[stop] - running[start]) * inverse[start])


def text_parts(raw: np.ndarray, most: int, ahead: int) -> Iterator[tuple[int, int, int]]:
    """(start, stop, end) in bytes: own parts of about `most` bytes of a long text, each with `ahead` bytes or more to look ahead.

    A part stops before white space if its last 64 KB have some, else between two characters.
    """
    start, n = 0, len(raw)
    while n - start > 2 * most:
        stop = start + most
        blank = np.flatnonzero(raw[max(start + 1, stop - (1 << 16)) : stop] <= 32)
        stop = max(start + 1, stop - (1 << 16)) + int(blank[-1]) if len(blank) else stop
        while raw[stop] & 0xC0 == 0x80:
            stop += 1
        end = min(n, stop + ahead)
        while end < n and raw[end] & 0xC0 == 0x80:
            end += 1
        yield start, stop, end
        start = stop
    yield start, n, n


def give_back() -> None:
    """Gives memory that this process no longer uses back to the host."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def tidy(run):
    """`run` (an Arrow map's function), after which the worker, which waits for its next task, holds no spare memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


#: Bits of the filter that tells which rows may have a partner.
FILTER_BITS = 24


def fresh(rows: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `rows` has it, in any case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def marked(rows: DataFrame, ids: DataFrame, column: str, mark: str = "_maybe") -> DataFrame:
    """`rows` with `mark`, a new name: whether `column` may be among those of `ids`; never false for one that is, null included.

    A filter of a fixed size (2^18 rows of 64 bits at most, so it can be broadcast) spares a join the rows that have no
    partner; what passes is still joined. With very many ids it lets everything through. Other columns may have any names.
    """
    low_name, word, bits = (fresh(rows, n) for n in ("_low", "_word", "_bits"))
    low = lambda c: F.xxhash64(c).bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.expr(f"shiftleft(1L, cast({low_name} & 63 AS int))")
    words = ids.select(low(F.col(column)).alias(low_name)).groupBy(F.shiftright(low_name, 6).alias(word)).agg(F.bit_or(bit).alias(bits))
    hashed = rows.withColumn(low_name, low(F.col(column))).withColumn(word, F.shiftright(low_name, 6))
    joined = hashed.join(F.broadcast(words), word, "left")
    held = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], held.alias(mark))


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """`rows` whose `column` is not in the written table `gone`; rows that cannot be in it are not shuffled. Null stays."""
    mark = fresh(rows, "_maybe")
    known = marked(rows, gone, column, mark)
    apart = known.where(~F.col(mark)).drop(mark)
    return apart.unionByName(known.where(F.col(mark)).drop(mark).join(gone, column, "left_anti"))


def by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` between bounds, in double precision; an empty row's is zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]
