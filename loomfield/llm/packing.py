"""Mixture-controlled packing of tokenised documents into sequences of a fixed length.

Each source is a queue of packets: its documents' ids in the order of the input, cut every `length` ids. Deficit round-robin
serves the queues window by window. A window adds to each queue's deficit its quantum, the window's tokens times the source's
share; the queue then sends packets while its deficit covers them, and carries the rest into the next window. A queue that
never runs dry before the end has sent, after w windows, just the packets whose running total is at most w quanta. So the
window of a packet follows from its running total alone, `ceil(total / quantum)`, and running totals are sums of partitions
carried from one partition to the next: no task goes through the windows one after another, and after any window each source
has had its share but for less than one packet.

With other targets than the corpus' own shares, some queues run dry first; the quanta of the rest then grow to fill the window.
If every queue q had sent f(q) * v tokens or all it has, whichever is less, the windows would hold R(v), the sum of these; a
packet with a running total of c leaves at v = c / f(q), so in window `ceil(R(c / f(q)) / window)`.

The stream of windows (in each, the sources by name, each source's packets in order) is cut into sequences of `length`. What is
left at the end is cut into sequences of powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.common import blocks, materialize, text_buffer, tidy

LENGTH = 2048
#: Tokens of a window of the mixture: 32 sequences.
WINDOW = 32 * LENGTH
#: Bytes of text that are encoded at once, and encoded words that a worker remembers.
BLOCK, REMEMBERED = 1 << 23, 1 << 20
#: Windows whose tokens are summed in one step of the running total.
FAN = 1024

# Kinds of bytes: 1 letters, 2 digits, 3 other visible ASCII, 4 blanks, 0 the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 4
_LETTER_LEAD = np.zeros(256, bool)  # two-byte characters of these leads are never white space
_LETTER_LEAD[0xC3:0xE0] = True


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Whether a text may be cut before each byte."""
    kind = _KIND[raw]
    before, here = kind[:-1], kind[1:]
    cut = np.zeros(len(raw), bool)
    cut[1:] = (before != here) & (before > 0) & (before < 4) & (here > 0) & ~((raw[:-1] == 0x27) & (here == 1))
    cut[2:] |= (kind[2:] == 4) & _LETTER_LEAD[raw[:-2]] & (raw[1:-1] >= 0x80)
    return cut


class Encoder:
    """Ids of texts by a local tokenizer file, each distinct word encoded once.

    The splitting pattern looks back at nothing and ends a match before each run of white space, and between ASCII letters, digits
    and other visible characters, but for an apostrophe before letters. So a text may be cut there: before a blank whose
    predecessor is surely no white space, and between two of these kinds.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the place and the number of its ids in the third array."""
        if len(self.known) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self._forget()
        place = pc.index_in(words, value_set=self.known)
        new = words.filter(place.is_null())
        for at in range(0, len(new), 4096):
            some = new.slice(at, 4096)
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
            self.count = np.append(self.count, np.fromiter(map(len, ids), np.int64, len(ids)))
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.uint32))
        if len(new):
            self.known = pa.concat_arrays([self.known, new])
            place = pc.index_in(words, value_set=self.known)
        place = np.asarray(place)
        return (np.cumsum(self.count) - self.count)[place], self.count[place], self.flat

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows that `bounds` cut from UTF-8 bytes, end to end, and the rows' bounds in ids."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        cut = _cuts(raw)
        cut[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        start = np.flatnonzero(cut)
        ends = pa.array(np.append(start, len(raw)).astype(np.int32))
        segments = pa.StringArray.from_buffers(len(start), ends.buffers()[1], pa.py_buffer(raw)).dictionary_encode()
        first, count, flat = self._ids(segments.dictionary)
        word = np.asarray(segments.indices)
        n = count[word]
        total = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(first[word] - total[:-1], n)
        place += np.arange(total[-1])
        return flat[place], total[np.searchsorted(start, bounds)]

    def rows(self, raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As `encode`, for blocks of rows; a long row is encoded in parts."""
        for begin, end in blocks(bounds, BLOCK):
            own = raw[bounds[begin] : bounds[end]]
            if len(own) <= 2 * BLOCK:
                yield self.encode(own, bounds[begin : end + 1] - bounds[begin])
                continue
            ids, at = [], 0
            while at < len(own):
                stop = _safe_stop(own, at)
                ids.append(self.encode(own[at:stop], np.array([0, stop - at]))[0])
                at = stop
            yield np.concatenate(ids), np.array([0, sum(map(len, ids))])


def _safe_stop(raw: np.ndarray, at: int) -> int:
    """The end of a part of about BLOCK bytes, at a place where a text may be cut; the whole rest where there is none."""
    for stop in range(at + BLOCK, len(raw), BLOCK):
        begin = stop - BLOCK + 1
        cut = np.flatnonzero(_cuts(raw[begin - 1 : stop + 1]))
        if len(cut):
            return begin - 1 + int(cut[-1])
    return len(raw)


def packets(docs: DataFrame, tokenizer_file: str, end_id: int, length: int, id_col: str, text_col: str, source_col: str, width: int = 4) -> DataFrame:
    """(part, at, queue, id_col, doc_tokens, start, length, before, ids): a packet is up to `length` ids of one document.

    `part` and `at` name it; `before` counts the ids of the same queue ahead of it in the part. Ids are little-endian, `width` bytes each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"part int, at long, queue string, `{id_col}` {kind}, doc_tokens long, start long, length long, before long, ids binary"
    names = ["part", "at", "queue", id_col, "doc_tokens", "start", "length", "before", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        sent: dict[str, int] = {}
        for batch in batches:
            data, bounds = text_buffer(batch.column(2))
            row = 0
            for ids, ends in encoder.rows(np.frombuffer(data, np.uint8), bounds):
                n_rows = len(ends) - 1
                own = np.diff(ends) + 1
                stop = ends[1:] + np.arange(1, n_rows + 1)
                flat = np.full(len(ids) + n_rows, end_id, f"<u{width}")
                body = np.ones(len(flat), bool)
                body[stop - 1] = False
                flat[body] = ids
                pieces = (own + length - 1) // length
                of = np.repeat(np.arange(n_rows), pieces)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * length
                size = np.minimum(length, own[of] - start)
                queue = batch.column(1).slice(row, n_rows).take(pa.array(of))
                before = np.empty(len(of), np.int64)
                for k, (q, s) in enumerate(zip(queue.to_pylist(), size.tolist(), strict=True)):
                    before[k] = sent.get(q, 0)
                    sent[q] = sent.get(q, 0) + s
                cut = pa.array(np.append(0, np.cumsum(size)) * width, pa.int32())
                binary = pa.Array.from_buffers(pa.binary(), len(of), [None, cut.buffers()[1], pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(of), part, np.int32)), pa.array(at + np.arange(len(of))), queue, batch.column(0).slice(row, n_rows).take(pa.array(of)),
                        pa.array(own[of]), pa.array(start), pa.array(size), pa.array(before), binary,
                    ],
                    names,
                )
                row, at = row + n_rows, at + len(of)

    queue = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    return docs.select(F.col(id_col), queue.alias("queue"), F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def id_width(tokenizer_file: str, end_id: int) -> int:
    """Bytes that hold any id."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def widened(rows: DataFrame, column: str, width: int) -> DataFrame:
    """`rows` with the ids of the last column, `column`, in 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column(batch.num_columns - 1))
            flat = np.frombuffer(data, f"<u{width}").astype("<u4")
            ends = pa.array((bounds * (4 // width)).astype(np.int32))
            wide = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends.buffers()[1], pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], wide], batch.schema.names)

    return rows if width == 4 else rows.mapInArrow(tidy(run), rows.schema)


def _ceil(a: Column, b: Column) -> Column:
    """The least whole number of at least a / b, exactly."""
    whole = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", whole(a) + whole(b) - 1, whole(b))


def _window(total: int, window: int, targets: dict[str, float] | None, sizes: DataFrame) -> Column:
    """The window, from 0, of a packet whose queue (of `queue_tokens`) has sent `sent` tokens with it."""
    if targets is None:
        exact = lambda c: F.col(c).cast("decimal(19,0)")
        return _ceil(exact("sent") * F.lit(total).cast("decimal(19,0)"), exact("queue_tokens") * F.lit(window).cast("decimal(19,0)")) - 1
    weight = {f"={name}": float(w) for name, w in targets.items() if w > 0}
    have = {r["queue"]: r["queue_tokens"] for r in sizes.where(F.col("queue").isin(list(weight))).collect()}
    named = sum(have.values())
    left = F.lit(float(named)) + F.col("sent") * F.lit(float(total - named)) / F.col("queue_tokens")
    if not have:
        return F.greatest(F.ceil(left / window) - 1, F.lit(0)).cast("long")
    queues = F.array(*[F.struct(F.lit(float(n)).alias("n"), F.lit(weight[q]).alias("w")) for q, n in sorted(have.items())])
    own = F.create_map(*[F.lit(x) for q in sorted(have) for x in (q, weight[q])])[F.col("queue")]
    served = F.aggregate(queues, F.lit(0.0), lambda sum_, q: sum_ + F.least(q["n"], q["w"] * F.col("sent") / own))
    return F.greatest(F.ceil(F.when(own.isNotNull(), served).otherwise(left) / window) - 1, F.lit(0)).cast("long")


def running(sums: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, ahead): the total of `value` under smaller keys, for one row a key of 0 to `most`.

    Blocks of FAN keys are summed, their totals run in turn, and added inside the blocks: no task sees over FAN rows of a block.
    """
    before = lambda *by: F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if most < FAN:
        return sums.select(key, before(F.lit(0)).alias("ahead"))
    block = F.floor(F.col(key) / FAN).cast("long")
    above = f"{key}_block"
    upper = running(sums.groupBy(block.alias(above)).agg(F.sum(value).alias(value)), above, value, most // FAN)
    inner = sums.select(key, block.alias(above), before(block).alias("inner"))
    return inner.join(upper, above).select(key, (F.col("inner") + F.col("ahead")).alias("ahead"))


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int = 1,
    length: int = LENGTH,
    window: int = WINDOW,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces (id_col, source, start, length, doc_tokens, sequence_id, offset, window, ids) that fill sequences of `length` ids.

    `targets` weighs sources by name; without it, each has its share of all tokens. Sources that it doesn't name come after those
    that it names. A null or empty text is `end_id` alone; a null source is a queue of its own; repeated rows are packed each;
    an empty table gives no piece; other columns are not read. Sources may be hot: nothing is grouped by source alone but sums
    of partitions. Ids are written once and shuffled once. The order is that of the partitions of `docs`.
    """
    width = id_width(tokenizer_file, end_id)
    held = materialize(packets(docs, tokenizer_file, end_id, length, id_col, text_col, source_col, width))
    runs = held.groupBy("part", "queue").agg(F.sum("length").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("part", "queue", "n", ahead.alias("parts_ahead")))
    sizes = runs.groupBy("queue").agg(F.sum("n").alias("queue_tokens"))
    total = runs.agg(F.sum("n")).first()[0] or 0
    known = held.select("part", "at", "queue", "length", "before").join(runs.join(sizes, "queue"), ["part", "queue"])
    known = known.withColumn("first", F.col("parts_ahead") + F.col("before")).withColumn("sent", F.col("first") + F.col("length"))
    placed = materialize(known.select("part", "at", "queue", "length", "first", _window(total, window, targets, sizes).alias("window")))

    spans = placed.groupBy("window", "queue").agg(F.min("first").alias("span_first"), F.sum("length").alias("n"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("window").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = materialize(spans.select("window", "queue", "span_first", "n", within.alias("within")))
    at = running(spans.groupBy("window").agg(F.sum("n").alias("n")), "window", "n", -(-total // window))
    spans = spans.join(at, "window").select("window", "queue", (F.col("ahead") + F.col("within") - F.col("span_first")).alias("shift"))
    offsets = placed.join(spans, ["window", "queue"]).select("part", "at", "window", (F.col("first") + F.col("shift")).alias("begin"))

    full = total // length
    tail = [full * length]
    while tail[-1] < total:
        tail.append(tail[-1] + (1 << ((total - tail[-1]).bit_length() - 1)))
    begin, end = F.col("begin"), F.col("begin") + F.col("length")
    ends = F.array(((F.floor(begin / length) + 1) * length).cast("long"), *[F.lit(t).cast("long") for t in tail])
    inner = F.filter(F.array_distinct(ends), lambda x: (x > begin) & (x < end) & (x <= total))
    points = F.concat(F.array(begin), F.array_sort(inner), F.array(end))
    cut = held.join(offsets, ["part", "at"]).withColumn("points", points)
    cut = cut.select("*", F.posexplode(F.slice("points", F.lit(1), F.size("points") - 1)).alias("nth", "from"))
    size = F.element_at("points", F.col("nth") + 2) - F.col("from")
    of_tail = F.size(F.filter(F.array(*[F.lit(t).cast("long") for t in tail]), lambda t: t <= F.col("from"))) - 1
    in_tail = F.col("from") >= full * length
    sequence_start = F.when(in_tail, F.element_at(F.array(*[F.lit(t).cast("long") for t in tail]), F.greatest(of_tail, F.lit(0)) + 1)).otherwise(F.floor(F.col("from") / length) * length)
    skipped = F.col("from") - begin
    out = cut.select(
        id_col,
        F.when(F.col("queue") != "null", F.expr("substring(queue, 2)")).alias("source"),
        (F.col("start") + skipped).alias("start"),
        size.alias("length"),
        "doc_tokens",
        F.when(in_tail, full + of_tail).otherwise(F.floor(F.col("from") / length)).cast("long").alias("sequence_id"),
        (F.col("from") - sequence_start).cast("long").alias("offset"),
        "window",
        F.substring(F.col("ids"), (skipped * width + 1).cast("int"), (size * width).cast("int")).alias("ids"),
    )
    return widened(out, "ids", width)
