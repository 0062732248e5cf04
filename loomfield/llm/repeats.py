"""Periodic runs of words: tandem repeats in linear fashion, after Gusfield and Stoye.

The texts of a block are sorted into one suffix tree a text, held as its leaves in order (a suffix array) with the depth at which
neighbours part, and with a name for every stretch of 2^k words, so that two stretches are compared in one step.

1. Each text is cut into Lempel-Ziv blocks, of which each is the longest stretch that began earlier. The right half of a square (a
   stretch and its repeat) reaches into at most one more block than it starts in, and a square inside one block isn't the first
   of its kind. So extending the two places that a block's border and a period define, by periods up to the blocks' lengths,
   gives squares whose rotations cover the first occurrence of every kind of square.
2. From each of these, suffix links (from a leaf to the leaf of the suffix one word shorter) lead from rotation to rotation, as
   long as the square goes on and its kind isn't marked yet. This completes the vocabulary. Squares of a repeated root are left
   out: their run has a smaller period.
3. The leaves below a kind are its occurrences. There are at most twice as many leaves below the first 2^k words of the kinds as
   words for each k, so reading them takes n log n. Occurrences at neighbouring places merge into runs.

Python workers get whole texts in Arrow batches; a text is never shuffled, and one text's memory is some 4 bytes a word for each
doubling of its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import WORD, blocks, text_buffer, tidy

#: A run has this many words at least, and this many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that are searched at once; depths at which the blocks' lengths are found by whole arrays.
BLOCK, SHALLOW = 1 << 22, 8


class Leaves:
    """The suffixes of a row of numbers in order, `parted[r]` the words that leaves r - 1 and r share, and names of stretches.

    Numbers of different texts must differ, so that nothing goes on beyond a text.
    """

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        self.leaf = np.argsort(words, kind="stable")
        sorted_words = words[self.leaf]
        head = np.append(True, sorted_words[1:] != sorted_words[:-1])[:n]
        name = np.full(n + 1, -1, np.int32)
        name[self.leaf] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.names = [name]
        self.parted = np.zeros(n + 1, np.int64)
        slots = _shared(head)
        while len(slots):
            reach = 1 << (len(self.names) - 1)
            at = self.leaf[slots]
            key = name[at].astype(np.int64) * (n + 1) + name[np.minimum(at + reach, n)] + 1
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            self.leaf[slots] = at
            head = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(head)
            new = first[1:][key[first[1:]] // (n + 1) == key[first[1:] - 1] // (n + 1)]  # parts here for the first time
            finer = name.copy()
            finer[at] = slots[first][np.cumsum(head) - 1]
            left, right = at[new - 1], at[new]
            self.parted[slots[new]] = reach + self.common(left + reach, right + reach)
            self.names.append(finer)
            name = finer
            slots = slots[_shared(head)]
        self.table = np.stack(self.names)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b (unequal places) share."""
        a, b, got = np.minimum(a, self.n), np.minimum(b, self.n), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            same = name[np.minimum(a + got, self.n)] == name[np.minimum(b + got, self.n)]
            got[same] += 1 << k
        return got

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words shared to the left, those at a and b included; b > a, and a may be -1."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            x, y = a - got - (1 << k) + 1, b - got - (1 << k) + 1
            same = (x >= 0) & (self.names[k][np.maximum(x, 0)] == self.names[k][np.maximum(y, 0)])
            got[same] += 1 << k
        return got

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether stretches of `size` words (1 at least) at a and b are equal."""
        k = _log2(size)
        deep = k >= len(self.names)  # no two places share so much
        k = np.minimum(k, len(self.names) - 1)
        end = size - (1 << k)
        return ~deep & (self.table[k, a] == self.table[k, b]) & (self.table[k, np.minimum(a + end, self.n)] == self.table[k, np.minimum(b + end, self.n)])


def _log2(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64) - 1


def _shared(head: np.ndarray) -> np.ndarray:
    """Places that are not alone between two heads."""
    return np.flatnonzero(~(head & np.append(head[1:], True)[: len(head)]))


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, j) for each j from 0 up to sizes[k]."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def earlier(tree: Leaves) -> np.ndarray:
    """For each place, the words of the longest stretch there that also starts further left."""
    found = np.zeros(tree.n, np.int64)
    at, parted = tree.leaf, tree.parted[: tree.n]
    for depth in range(1, SHALLOW + 2):
        head = parted < depth
        head[:1] = True
        keep = _shared(head)
        at, parted, head = at[keep], parted[keep], head[keep]
        if not len(at):
            return found
        if depth <= SHALLOW:
            begin = np.flatnonzero(head)
            least = np.repeat(np.minimum.reduceat(at, begin), np.diff(np.append(begin, len(at))))
            found[at[at > least]] = depth
    # Deeper, places leave a linked list of leaves from the right; a place's neighbours then are the nearest that start earlier.
    depth_of = np.append(np.where(head, 0, parted), 0).tolist()
    before, after = list(range(-1, len(at))), list(range(1, len(at) + 2))
    order = np.argsort(-at, kind="stable")
    deepest = []
    for j in order.tolist():
        a, k = depth_of[j], after[j]
        b, i = depth_of[k], before[j]
        if a > b:
            deepest.append(a)
            depth_of[k] = b
        else:
            deepest.append(b)
            depth_of[k] = a
        before[k] = i
        after[i] = k
    found[at[order]] = np.maximum(found[at[order]], deepest)
    return found


def covering(tree: Leaves, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares of which the rotations to the right hold the first square of each kind."""
    step = np.maximum(earlier(tree), 1).tolist()
    cuts, at = [], 0
    while at < tree.n:
        cuts.append(at)
        at += step[at]
    cut = np.array([*cuts, tree.n], np.int64)
    begin, end = cut[:-1], cut[1:]
    text = np.searchsorted(bounds, begin, side="right") - 1
    floor, ceiling = bounds[text], bounds[text + 1]
    size = end - begin
    following = np.append(size[1:], 0) * (end < ceiling)
    name = tree.names[0]
    found = []
    for border, most, sign in ((begin, size, 1), (end, np.where(following > 0, size + following, 0), -1)):
        most = np.minimum(most, ceiling - border if sign > 0 else border - floor)
        of, period = _spread(most)
        period += 1
        here = border[of]
        left, right = (here, here + period) if sign > 0 else (here - period, here)
        some = (name[left] == name[right]) | ((left > 0) & (name[left - 1] == name[right - 1]))
        of, period, left, right = of[some], period[some], left[some], right[some]
        ahead, back = tree.common(left, right), tree.common_before(left - 1, right - 1)
        start = np.maximum(left - np.minimum(back, period), floor[of])
        ok = start <= np.minimum(left, left + ahead - period)
        found.append((start[ok], period[ok]))
    start, period = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, period


def primitive(tree: Leaves, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the root of each square is no repetition of a shorter one: for no prime r has it the period of an r-th."""
    ok, left, prime = np.ones(len(start), bool), period.copy(), 2
    while len(left) and left.max() > 1:
        if prime * prime > left.max():  # what is left of each is 1 or a prime
            some = np.flatnonzero(left > 1)
            part = period[some] // left[some]
            ok[some] &= ~tree.equal(start[some], start[some] + part, period[some] - part)
            break
        some = np.flatnonzero(left % prime == 0)
        if len(some):
            part = period[some] // prime
            ok[some] &= ~tree.equal(start[some], start[some] + part, period[some] - part)
            while len(some):
                left[some] //= prime
                some = some[left[some] % prime == 0]
        prime += 1
    return ok


def squares(tree: Leaves, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all occurrences of the kinds of squares that rotations of the given ones reach."""
    ok = primitive(tree, start, period)
    start, period = start[ok], period[ok]
    links = np.minimum(tree.common(start, start + period) - period + 1, period)
    of, nth = _spread(links)
    place, period = start[of] + nth, period[of]
    level = _log2(2 * period)
    # A kind is marked by its period and the name of its first 2^level words, which hold its root.
    _, one = np.unique(np.stack([period, tree.table[level, place].astype(np.int64)]), axis=1, return_index=True)
    place, period, level = place[one], period[one], level[one]
    places, periods = [], []
    for k in np.unique(level).tolist():
        own = np.flatnonzero(level == k)
        first = tree.names[k][place[own]].astype(np.int64)
        border = np.append(np.flatnonzero(tree.parted[: tree.n] < (1 << k)), tree.n)
        of, nth = _spread(border[np.searchsorted(border, first, side="right")] - first)
        at, q = tree.leaf[first[of] + nth], period[own][of]
        held = np.flatnonzero(at + 2 * q <= tree.n)
        at, q = at[held], q[held]
        held = tree.equal(at, at + q, q)
        places.append(at[held])
        periods.append(q[held])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs(words: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) by text, start and period. `words` are numbers from 0, `bounds` cut them into texts."""
    if not len(words):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    tree = Leaves(text * (int(words.max()) + 1) + words)
    place, period = squares(tree, *covering(tree, bounds))
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    head = np.append(True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1))[: len(place)]
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], len(place))[: len(begin)] - 1
    start, period = place[begin], period[begin]
    length = place[end] - start + 2 * period
    long = length >= np.maximum(least_words, least_periods * period)
    start, length, period = start[long], length[long], period[long]
    text = np.searchsorted(bounds, start, side="right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - bounds[text])[order], length[order], period[order]


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of the rows that `bounds` cut from UTF-8 bytes, and the rows' bounds in words."""
    ends = pa.array(bounds, pa.int64())
    text = pa.LargeStringArray.from_buffers(len(bounds) - 1, ends.buffers()[1], pa.py_buffer(raw))
    split = pc.ascii_split_whitespace(text)
    words = split.flatten()
    some = pc.not_equal(words, "")
    n = np.bincount(np.asarray(pc.list_parent_indices(split).filter(some)), minlength=len(bounds) - 1)
    return words.filter(some).dictionary_encode(), np.concatenate([[0], np.cumsum(n)])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(id_col, runs, collapsed) of each row: its runs (start, length, period in words, by start and period) and its text without repeats.

    A run is a longest stretch of words with a smallest period, of `least_words` words and `least_periods` periods at least. The
    collapsed text has, joined by one space, the words that no run holds after its first period. Null and empty texts have no
    run and an empty text; repeated rows stay; other columns are not read; an empty table gives no row. A map without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def searched(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
        words, ends = _words(raw, bounds)
        n = len(ends) - 1
        text, start, length, period = runs(np.asarray(words.indices).astype(np.int64), ends, least_words, least_periods)
        within = np.zeros(ends[-1] + 1, np.int64)
        np.add.at(within, ends[text] + start + period, 1)
        np.add.at(within, ends[text] + start + length, -1)
        kept = np.flatnonzero(np.cumsum(within[:-1]) == 0)
        cut = pa.array(np.searchsorted(kept, ends), pa.int64())
        left = pa.LargeListArray.from_arrays(cut, words.dictionary.take(words.indices.take(pa.array(kept))))
        found = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(run_type))
        own = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
        return pa.ListArray.from_arrays(own, found), pc.binary_join(left, pa.scalar(" ", words.dictionary.type)).cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            raw = np.frombuffer(data, np.uint8)
            for start, end in blocks(bounds, BLOCK):
                found, left = searched(raw[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), found, left], [id_col, "runs", "collapsed"])

    schema = f"`{id_col}` {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def strongest(found: Column) -> Column:
    """Of an array of runs the one with the greatest length/period, exactly; ties by smallest start, then period. Null for none."""
    ahead = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(found, F.get(found, F.lit(0)), lambda best, r: F.when(ahead(best, r), r).otherwise(best))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col): every tenth document, by the crc32 of its id, goes on periodically from a word that the crc32 picks.

    With h the crc32 of the decimal id, g = h div 10 and n words, words from a = g % n on become word a + (i - a) % p with
    p = 1 + (n - a) div (3 + g % 8). Only those texts are split here; a null id leaves a text as it is.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    parts = F.struct(words.alias("w"), F.size(words).cast("long").alias("n"))
    chosen = docs.select(id_col, text_col, h.alias("h"), g.alias("g"), F.when(h % 10 == 0, parts).alias("parts"))
    n = F.col("parts.n")
    a = F.col("g") % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % period)
    planted = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(F.col("parts.w"), at(i).cast("int")))
    return chosen.select(id_col, F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col(text_col)).alias(text_col))
