"""Benchmark decontamination by latent semantic retrieval.

The terms are the words of the benchmark, the passages runs of words of every document. One pass over
the corpus gathers document frequencies and a random sketch of the passages' Gram matrix, of a fixed
number of columns; the driver turns the sketch into the leading singular vectors of the TF-IDF matrix
(the Nystrom form of randomised SVD: inverse document frequencies scale rows, so they can be applied
after the pass). A second pass folds overlapping windows and benchmark passages into the latent space;
pairs whose cosine reaches a threshold are candidates, as are places that hold as many of an item's rarest
words as any match must. Candidates are verified by the longest common
subsequence of words; a subsequence that is long but not near complete also needs the item's answer, or
where it names none enough of its words weighed by inverse document frequency.

A large benchmark is searched for in blocks of items of WORDS words in all, whatever the corpus; which words tell
items apart, and what they weigh, is counted over all items, so blocks don't change what is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import blocks, materialize, text_buffer, tidy, word_hashes

#: Words of the benchmark items that are searched for in one go (one item at least); a larger benchmark takes more passes.
WORDS = 1 << 15
#: Words of a passage of the sketch, between search windows, and of a benchmark passage. A window is three strides.
PASSAGE, STRIDE, QUERY = 64, 16, 40
WINDOW = 3 * STRIDE
RANK, OVERSAMPLE = 160, 12
COSINE = 0.4
#: Words in more than this share of the items, and in two or more, are no terms: they tell no item from another.
STOP_SHARE = 0.06
#: Shares of the item's words in the common subsequence: enough alone, and enough with the answer.
COPY, PARAPHRASE = 0.8, 0.5
#: Share of an item's words by inverse document frequency that a paraphrase has of an item that names no answer.
TELLING_SHARE = 0.5
#: Small enough for a block's vectors to stay in the cache.
_BLOCK = 1 << 17
#: A word is a run of ASCII letters, digits and bytes of other characters; upper case counts as lower.
_LETTER = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_VALUE[65:91] = _VALUE[97:123]


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(raw, bounds, _LETTER, _VALUE)


class Vocabulary:
    """Ids of known word hashes, by a table of their low bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = max(12, int(len(self.hashes) * 8).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.spilled = np.zeros(0, np.int64)
        low = (self.hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        self.table[low[::-1]] = np.arange(len(self.hashes))[::-1]
        self.spilled = np.flatnonzero(self.table[low] != np.arange(len(low)))

    def parts(self) -> tuple:
        """Plain arrays to broadcast: an instance would be pickled by reference, and executors have no copy of the package."""
        return self.hashes, self.bits, self.table, self.spilled

    @classmethod
    def of(cls, parts: tuple) -> Vocabulary:
        self = cls.__new__(cls)
        self.hashes, self.bits, self.table, self.spilled = parts
        return self

    def ids(self, words: np.ndarray) -> np.ndarray:
        got = self.table[(words & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
        got = np.where((got >= 0) & (self.hashes[got] == words), got, -1)
        if len(self.spilled):
            rest = np.flatnonzero(got < 0)
            other = self.hashes[self.spilled]
            at = np.minimum(np.searchsorted(other, words[rest]), len(other) - 1)
            got[rest] = np.where(other[at] == words[rest], self.spilled[at], -1)
        return got


def term_rows(ids: np.ndarray, bounds: np.ndarray, telling: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(terms, passages with each, sketch rows of each, passages) of a block of rows' word ids.

    A token adds its row of the test matrix to its passage, and its passage's sum to its term.
    """
    size = np.diff(bounds)
    count = -(-size // PASSAGE)
    first = np.cumsum(count) - count
    known = np.flatnonzero((ids >= 0) & telling[ids])
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, omega.shape[1])), int(count.sum())
    row = np.searchsorted(bounds, known, side="right") - 1
    passage, term = first[row] + (known - bounds[row]) // PASSAGE, ids[known]
    fresh = np.diff(passage, prepend=-1) > 0
    sums = np.add.reduceat(omega[term], np.flatnonzero(fresh))
    order = np.argsort(term, kind="stable")
    term, owner = term[order], (np.cumsum(fresh) - 1)[order]
    heads = np.diff(term, prepend=-1) > 0
    cuts = np.flatnonzero(heads)
    # Tokens of a term stand in the order of their passages, so a passage's repeats are neighbours.
    once = heads | (np.diff(owner, prepend=-1) != 0)
    return term[cuts], np.add.reduceat(once.astype(np.int64), cuts), np.add.reduceat(sums[owner], cuts), int(count.sum())


def sketch(docs: DataFrame, text_col: str, vocabulary: Vocabulary, telling: np.ndarray, omega: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Passages of all documents, passages with each term, and the sketch (terms x columns)."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.parts(), telling, omega))
    width = omega.shape[1]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, terms, columns = shared.value
        words = Vocabulary.of(parts)
        total = np.zeros((len(columns) + 1, width + 1))
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            raw = np.frombuffer(data, np.uint8)
            for i, j in blocks(offsets, _BLOCK):
                found, bounds = _words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                term, seen, part, passages = term_rows(words.ids(found), bounds, terms, columns)
                total[term, 0] += seen
                total[term, 1:] += part
                total[-1, 0] += passages
        yield from _rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value[2]) + 1, width + 1))
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width + 1)
            np.add.at(total, batch.column(0).to_numpy(zero_copy_only=False), values)
        yield from _rows(total)

    def _rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(total[:, 0])
        flat = pa.array(total[at].ravel())
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (width + 1)), flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), values], ["term", "values"])

    schema = "term long, values array<double>"
    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    summed = text.mapInArrow(tidy(gather), schema).repartition("term").mapInArrow(tidy(add), schema)
    total = np.zeros((len(omega) + 1, width + 1))
    for row in summed.toLocalIterator():
        total[row["term"]] += row["values"]
    return int(total[-1, 0]), total[:-1, 0], total[:-1, 1:]


def latent(passages: int, seen: np.ndarray, raw: np.ndarray, omega: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(inverse document frequencies, latent row of each term) from the sketch of raw counts.

    With D the frequencies' diagonal and the test matrix D^-1 omega, D raw is the sketch of the weighted
    Gram matrix and omega' raw its core; the factor of the core turns the sketch into singular vectors.
    """
    idf = np.log((passages + 1) / (seen + 1)) + 1
    core = omega.T.astype(np.float64) @ raw
    core = (core + core.T) / 2
    core += np.eye(len(core)) * max(1e-9 * np.trace(core), 1e-9)
    values, vectors = np.linalg.eigh(core)
    values = np.maximum(values, values[-1] * 1e-10)
    left, singular, _ = np.linalg.svd((raw * idf[:, None]) @ (vectors / np.sqrt(values)), full_matrices=False)
    keep = singular[:rank] > 1e-6 * max(singular[0], 1e-12)
    basis, singular = left[:, :rank][:, keep], singular[:rank][keep]
    return idf, (idf[:, None] * basis / np.sqrt(singular)).astype(np.float32)


def common_subsequence(item: np.ndarray, other: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, a machine word's row at a time."""
    at: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in other.tolist():
        if match := at.get(w):
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _items(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None) -> list[tuple]:
    """The benchmark's items that have words, in order; repeats of an id with the same text count once."""
    columns = [F.col(item_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    columns.append(F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string"))
    return sorted({tuple(r) for r in benchmark.select(*columns).toLocalIterator()}, key=lambda r: (str(r[0]), r[1]))


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _words(raw, np.array([0, len(raw)]))[0]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
) -> DataFrame:
    """(id, item, kind, share, cosine, start_word, end_word): the best match of each document and item found.

    `kind` is copy or paraphrase, `share` the common subsequence's part of the item's words. Null and
    empty texts match nothing, nor do items without words. Repeated rows each have their matches; with no
    benchmark, or an empty table, there are none. Ties of share go to the first window.
    """
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    item_kind = benchmark.select(item_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, kind string, share double, cosine double, start_word long, end_word long"
    items = [(i, _hashes(t), _hashes(a) if a else None) for i, t, a in _items(benchmark, item_col, item_text_col, answer_col)]
    # Items of the same words and answer are searched for once and named by all their ids.
    same: dict[tuple, tuple] = {}
    for i, own, answer in items:
        if len(own):
            same.setdefault((own.tobytes(), answer.tobytes() if answer is not None else None), ([], own, answer))[0].append(i)
    items = list(same.values())
    if not items:
        return spark.createDataFrame([], schema)
    known, within = np.unique(np.concatenate([np.unique(x[1]) for x in items]), return_counts=True)
    size = np.cumsum([len(x[1]) for x in items])
    out = None
    for block in np.split(np.arange(len(items)), np.flatnonzero(np.diff(size // WORDS)) + 1):
        part = _search(docs, [items[k] for k in block], (known, within, len(items)), id_col, text_col, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _search(docs: DataFrame, items: list[tuple], frequency: tuple[np.ndarray, np.ndarray, int], id_col: str, text_col: str, schema: str) -> DataFrame:
    """Matches of `items`; `frequency` has the words of all items, the items that have each, and the number of items."""
    words = Vocabulary(np.concatenate([x[1] for x in items] + [x[2] for x in items if x[2] is not None]))
    omega = np.random.default_rng(5).choice(np.array([-1, 1], np.float32), (len(words.hashes), RANK + OVERSAMPLE))
    sequences = [words.ids(x[1]) for x in items]
    known, counted, total = frequency
    # A word of an answer alone is in no item.
    place = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
    within = np.where(known[place] == words.hashes, counted[place], 0)
    telling = within <= max(1, STOP_SHARE * total)
    passages, seen, raw = sketch(docs, text_col, words, telling, omega)
    # The sketch counts terms only; of the other words the share of the items that have them stands for that of the passages.
    seen = np.where(telling, seen, passages * within / total)
    idf, rows = latent(passages, seen, raw, omega)
    rows[~telling] = 0
    answers = [words.ids(x[2]) if x[2] is not None and len(x[2]) else None for x in items]
    queries, owners = [], []
    for k, sequence in enumerate(sequences):
        for part in np.array_split(sequence, -(-len(sequence) // QUERY)):
            queries.append(rows[part].sum(axis=0))
            owners.append(k)
    queries = np.array(queries, np.float32)
    queries /= np.linalg.norm(queries, axis=1, keepdims=True) + 1e-9
    names = [x[0] for x in items]
    shared = docs.sparkSession.sparkContext.broadcast((words.parts(), telling, rows, queries, np.array(owners), sequences, answers, names, seen, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, telling, rows, queries, owners, sequences, answers, names, seen, idf = shared.value
        words = Vocabulary.of(parts)
        checks = Checks(telling, sequences, answers, seen, idf)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            raw = np.frombuffer(data, np.uint8)
            found = []
            for i, j in blocks(offsets, _BLOCK):
                hashes, bounds = _words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = words.ids(hashes)
                for row, k, *rest in matches(ids, bounds, rows, queries, owners, checks):
                    found.extend((batch.column(0)[i + row].as_py(), name, *rest) for name in names[k])
            columns = list(zip(*found, strict=True)) or [[] for _ in range(7)]
            types = [batch.schema[0].type, pa.array([n for own in names for n in own]).type, pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], target)

    target = [id_col, schema.split("`")[3], "kind", "share", "cosine", "start_word", "end_word"]
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(tidy(run), schema)


class Checks:
    """What verification needs of the items: sequences, answers, weights, and which words an item has.

    An item's anchors are its rarest words, so many that a common subsequence of PARAPHRASE leaves `need` of
    them at least; `posted` and `holders` list the items of each term that is an anchor.
    """

    def __init__(self, telling: np.ndarray, sequences: list[np.ndarray], answers: list[np.ndarray | None], seen: np.ndarray, idf: np.ndarray):
        self.telling, self.sequences, self.answers = telling, sequences, answers
        self.sizes = np.array([len(s) for s in sequences])
        self.plain = np.array([np.count_nonzero(~telling[s]) for s in sequences])
        self.weights = [idf[s] - 1 for s in sequences]
        self.idf = idf - 1
        # Least weight in telling words that a paraphrase has of an item without an answer.
        self.floor = np.array([TELLING_SHARE * w.sum() - w[~telling[s]].sum() for w, s in zip(self.weights, sequences, strict=True)])
        self.floor[[a is not None for a in answers]] = 0
        #: Times that an item has one of its telling words.
        self.times = np.array([np.unique(s[telling[s]], return_counts=True)[1].max(initial=1) for s in sequences])
        self.scratch = np.zeros(len(telling) + 1, bool)
        # Whether an item has a word, by a table of hashed pairs: true for all pairs there are, and for few others.
        self.mask = (1 << max(12, (16 * int(self.sizes.sum())).bit_length())) - 1
        self.pairs = np.zeros(self.mask + 1, bool)
        for k, s in enumerate(sequences):
            self.pairs[self.slot(k, s)] = True
        self.need = np.maximum(1, self.sizes // 8)
        kept = np.ceil(PARAPHRASE * self.sizes).astype(np.int64)
        anchors = [np.unique(s[np.argsort(seen[s], kind="stable")][: n - m + k]) for s, n, m, k in zip(sequences, self.sizes, kept, self.need, strict=True)]
        terms, holders = np.concatenate(anchors), np.repeat(np.arange(len(anchors)), [len(x) for x in anchors])
        self.holders = holders[np.argsort(terms, kind="stable")]
        self.posted = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(telling)))])

    def slot(self, item, term):
        return (np.int64(0x9E3779B1) * item + np.int64(0x85EBCA6B) * term >> 7) & self.mask

    def possible(self, item: np.ndarray, pair: np.ndarray, owner: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether the telling words (owner's item, pair, term) around each of some places are enough for a match at best."""
        held = self.pairs[self.slot(owner, term)]
        pair, term = pair[held], term[held]
        n, weight = (np.bincount(pair, weights=w, minlength=len(item)) * self.times[item] for w in (None, self.idf[term]))
        words, size = n + self.plain[item], self.sizes[item]
        return (words >= COPY * size) | ((words >= PARAPHRASE * size) & (weight >= self.floor[item] - 1e-9))

    def open(self, item: int, around: np.ndarray) -> bool:
        """Whether the words alone, in any order, allow a match."""
        self.scratch[around] = True
        self.scratch[-1] = False
        held = self.scratch[self.sequences[item]]
        answered = self.answers[item] is not None and bool(self.scratch[self.answers[item]].all())
        self.scratch[around] = False
        n = np.count_nonzero(held)
        if n >= COPY * len(held):
            return True
        if n < PARAPHRASE * len(held) or self.answers[item] is not None:
            return n >= PARAPHRASE * len(held) and answered
        weight = self.weights[item]
        return 0 < TELLING_SHARE * weight.sum() <= weight[held].sum()

    def told(self, item: int, around: np.ndarray) -> bool:
        """Whether a paraphrase says what the item says: its answer, or where it names none enough of its telling words."""
        if self.answers[item] is not None:
            return bool(np.isin(self.answers[item], around).all())
        weight = self.weights[item]
        return 0 < TELLING_SHARE * weight.sum() <= weight[np.isin(self.sequences[item], around)].sum()


def anchored(ids: np.ndarray, bounds: np.ndarray, checks: Checks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, item) of the surroundings of all places with `need` of an item's anchors within its words and half a window.

    A copy or paraphrase that is no longer than that holds such a place, whatever its cosine.
    """
    known = np.flatnonzero(ids >= 0)
    n = checks.posted[ids[known] + 1] - checks.posted[ids[known]]
    known, n = known[n > 0], n[n > 0]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(checks.posted[ids[known]], n)
    item, at = checks.holders[place], np.repeat(known, n)
    row = np.searchsorted(bounds, at, side="right") - 1
    key = row * len(checks.sizes) + item
    order = np.argsort(key, kind="stable")
    key, item, at, row = key[order], item[order], at[order], row[order]
    last = np.arange(len(key)) + checks.need[item] - 1
    inside = last < len(key)
    last = np.where(inside, last, 0)
    hit = np.flatnonzero(inside & (key[last] == key) & (at[last] - at < checks.sizes[item] + WINDOW // 2))
    # One of the places that start in a stride stands for all of them.
    slot = at[hit] // STRIDE
    hit = hit[(np.diff(key[hit], prepend=-1) != 0) | (np.diff(slot, prepend=-1) != 0)]
    row, item, at = row[hit], item[hit], at[hit]
    start = np.maximum(at - checks.sizes[item], bounds[row])
    return row, start, np.minimum(at + checks.sizes[item] + STRIDE + WINDOW // 2, bounds[row + 1]), item


def candidates(ids: np.ndarray, bounds: np.ndarray, telling: np.ndarray, rows: np.ndarray, queries: np.ndarray):
    """(window's row, first word, query, cosine) of all windows whose cosine with a query reaches COSINE.

    A stride's terms are summed once; a window is three strides' sum.
    """
    size = np.diff(bounds)
    strides = -(-size // STRIDE)
    wide = strides + 2  # two empty ones close a row
    first = np.cumsum(wide) - wide
    known = np.flatnonzero((ids >= 0) & telling[ids])
    row = np.searchsorted(bounds, known, side="right") - 1
    stride = first[row] + (known - bounds[row]) // STRIDE
    sums = np.zeros((int(wide.sum()), rows.shape[1]), np.float32)
    heads = np.flatnonzero(np.diff(stride, prepend=-1))
    if not len(heads):
        return
    sums[stride[heads]] = np.add.reduceat(rows[ids[known]], heads)
    count = np.maximum(strides - 2, size > 0)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    for at in range(0, len(owner), 4096):
        part = slice(at, at + 4096)
        head = first[owner[part]] + nth[part]
        vector = sums[head]
        vector += sums[head + 1]
        vector += sums[head + 2]
        norm = np.sqrt(np.einsum("ij,ij->i", vector, vector))
        cosine = vector @ queries.T
        w, q = np.nonzero(cosine >= COSINE * np.maximum(norm, 1e-6)[:, None])
        if len(w):
            yield owner[part][w], bounds[owner[part][w]] + STRIDE * nth[part][w], q, cosine[w, q] / norm[w]


def regions(ids, bounds, rows, queries, owners, checks: Checks):
    """(row, start, end, item, cosine) to verify: around near windows, and around anchors, whose cosine is found later."""
    for row, start, query, cosine in candidates(ids, bounds, checks.telling, rows, queries):
        item = owners[query]
        reach = np.maximum(checks.sizes[item] // 2, STRIDE)
        yield row, np.maximum(start - reach, bounds[row]), np.minimum(start + WINDOW + reach, bounds[row + 1]), item, cosine
    row, start, end, item = anchored(ids, bounds, checks)
    for i in range(0, len(row), 4096):
        part = slice(i, i + 4096)
        yield row[part], start[part], end[part], item[part], np.full(len(row[part]), np.nan)


def matches(ids, bounds, rows, queries, owners, checks: Checks):
    """(row, item, kind, share, cosine, start, end) of the best verified window of each row and item."""
    best: dict[tuple[int, int], tuple] = {}
    telling = np.flatnonzero((ids >= 0) & checks.telling[ids])
    for row, start, end, item, cosine in regions(ids, bounds, rows, queries, owners, checks):
        # The subsequence has no more telling words than the item and the window with its surroundings share.
        low = np.searchsorted(telling, start)
        n = np.searchsorted(telling, end) - low
        pair = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        for k in np.flatnonzero(checks.possible(item, pair, item[pair], ids[telling[place]])):
            own, around = checks.sequences[item[k]], ids[start[k] : end[k]]
            if not checks.open(item[k], around):
                continue
            share = common_subsequence(own, around[around >= 0]) / len(own)
            if share < PARAPHRASE or (share < COPY and not checks.told(item[k], around)):
                continue
            key = int(row[k]), int(item[k])
            if key not in best or share > best[key][1]:
                span = int(start[k] - bounds[row[k]]), int(end[k] - bounds[row[k]])
                near = cosine[k]
                if np.isnan(near):
                    vector = rows[around[around >= 0]].sum(axis=0)
                    near = (queries[owners == item[k]] @ vector).max() / max(np.linalg.norm(vector), 1e-6)
                best[key] = ("copy" if share >= COPY else "paraphrase", float(share), float(near), *span)
    for (row, item), got in sorted(best.items()):
        yield row, item, *got


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """`docs` without the rows whose id has a match. Rows with a null id stay."""
    # The written ids' size tells the planner whether to send them to all or to shuffle.
    found = materialize(contaminated(docs, benchmark, id_col, text_col, **names).select(id_col).distinct())
    return docs.join(found, id_col, "left_anti")
