"""Near copies of a given similarity, by SimHash and soft-decision Golay decoding.

Two texts that share 0.8 of their five-word shingles differ in about a seventh of their fingerprint bits, too
many for a code of a few errors. So the fingerprint has 16 segments of 23 places, and each segment is decoded
with its margins (how far over or under a half of the shingles set a bit) to the codeword nearest to it: two such
texts agree in a segment's codeword in a quarter of the cases, where hard bits agree in an eighth. A key is the
codeword indices of two segments: 120 keys a text, two of whose segments agree with a chance of 0.95.

Keys carry 128 bits of the fingerprint, so a bucket's pairs are compared where they meet and strangers never
leave it. First each text is compared, shingle by shingle, with its nearest candidates of all its buckets, which
joins most with a number of links in proportion to the texts. Then the texts that have candidates in another
component are keyed again, and what hangs together by candidate pairs is one block. A block's texts meet in tiles
of a bounded size, where all pairs of different components are compared in place; only links leave a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import discard, marked, materialize, mixed, text_buffer, tidy, without, word_hashes
from loomfield.llm.components import components
from loomfield.llm.simhash import GENERATOR

SEGMENTS = 16
BITS = 23 * SEGMENTS
#: Differing bits of the 128 that a key carries beyond which a similarity of 0.8 is out of the question: 19 are
#: expected, and 36 are four standard deviations more.
MOST_BITS = 36
#: Nearest candidates with which a text is compared in the first round.
NEAREST = 2
#: Rows of a bucket that are compared with one another at once; a larger bucket is dealt out in tiles.
TILE = 2048
#: Texts and bytes of shingle hashes of half a tile of a block.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
_NOT_SPACE = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
_VALUES = np.random.default_rng(23).integers(1, 1 << 63, 256, np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_SHINGLE = np.random.default_rng(29).integers(1, 1 << 63, 1, np.uint64)[0] | np.uint64(1)
_SALTS = np.random.default_rng(17).integers(1, 1 << 63, -(-BITS // 64), np.uint64)
#: Eight counters of a byte each, for the bits of a byte.
_LANES = np.array([sum((v >> b & 1) << 8 * b for b in range(8)) for v in range(256)], np.uint64)


def codewords() -> np.ndarray:
    """[4096, 23] of -1 and 1: the codewords by their index, the polynomial that the generator is multiplied by."""
    index = np.arange(4096, dtype=np.uint32)
    word = np.zeros(4096, np.uint32)
    for i in range(12):
        word ^= np.where(index >> np.uint32(i) & np.uint32(1), np.uint32(GENERATOR << i), np.uint32(0))
    return ((word[:, None] >> np.arange(23, dtype=np.uint32) & np.uint32(1)) * 2.0 - 1).astype(np.float32)


def shingle_set(text: bytes | memoryview, words: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, in order; one of fewer words is one shingle. A-Z count as a-z."""
    raw = np.frombuffer(text, np.uint8)
    h = word_hashes(raw, np.array([0, len(raw)]), _NOT_SPACE, _VALUES)[0]
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _SHINGLE + h[i : len(h) - k + 1 + i]
        return np.unique(mixed(out))


def margins(shingles: np.ndarray) -> np.ndarray:
    """For each of BITS bits, the shingles whose hash has it set less those that haven't."""
    ones = np.zeros(64 * len(_SALTS), np.int64)
    for i in range(0, len(shingles), 1 << 13):
        part = shingles[i : i + (1 << 13)]
        with np.errstate(over="ignore"):
            h = (part[:, None] ^ _SALTS) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        lanes = _LANES[(h ^ (h >> np.uint64(29))).view(np.uint8)]
        # Eight counters of a byte each in a number hold 255 shingles.
        ones += np.add.reduceat(lanes, np.arange(0, len(part), 255)).view(np.uint8).sum(axis=0, dtype=np.int64)
    return (2 * ones[:BITS] - len(shingles)).astype(np.float32)


def decoded(of_rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """[n, SEGMENTS] indices of the codewords nearest to rows of margins; of equally near ones the first."""
    out = np.empty((len(of_rows), SEGMENTS), np.int64)
    for i in range(0, len(of_rows), 16):
        out[i : i + 16] = (of_rows[i : i + 16].reshape(-1, 23) @ words.T).argmax(axis=1).reshape(-1, SEGMENTS)
    return out


def sketch(of_rows: np.ndarray) -> np.ndarray:
    """[n, 2] numbers: the first eight bits of each segment."""
    bits = (of_rows > 0).reshape(-1, SEGMENTS, 23)[:, :, :8].reshape(-1, 8 * SEGMENTS)
    return np.packbits(bits, axis=1).view(np.int64)


def similarity(a: str, b: str, words: int = 5) -> float:
    """Jaccard similarity of two texts' sets of shingles; texts without words are alike."""
    return _jaccard(shingle_set(a.encode(), words), shingle_set(b.encode(), words))


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _node_of(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def prints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, node, size, x, y, c0 ... c3) of every row; `node` is a digest of the set of shingles, c0 ... c3 hold the indices."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["id", "node", "size", "x", "y", "c0", "c1", "c2", "c3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codewords()
        for batch in batches:
            data, at = text_buffer(batch.column(1))
            nodes, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32)
            rows = np.zeros((batch.num_rows, BITS), np.float32)
            for k in range(batch.num_rows):
                own = shingle_set(data[at[k] : at[k + 1]], words)
                nodes[k], sizes[k], rows[k] = _node_of(own), len(own), margins(own)
            near = decoded(rows, table).reshape(-1, 4, 4) << np.array([0, 12, 24, 36])
            packed = np.bitwise_or.reduce(near, axis=2)
            marks = sketch(rows)
            columns = [nodes.view(np.int64), sizes, *marks.T, *packed.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in columns]], names)

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(tidy(run), f"id {kind}, node long, size int, x long, y long, c0 long, c1 long, c2 long, c3 long")


def keyed(nodes: DataFrame) -> DataFrame:
    """The nodes (node, component, size, x, y, c0 ... c3) once for each key, each key's rows one after another.

    Keys are dealt out by ranges of (key, node), so the rows of a key that very many nodes have lie in several tasks.
    """
    index = lambda k: F.shiftright(f"c{k // 4}", 12 * (k % 4)).bitwiseAND(4095)
    pairs = [(i, j) for i in range(SEGMENTS) for j in range(i)]
    own = nodes.select("*", *[index(k).alias(f"i{k}") for k in range(SEGMENTS)])
    keys = F.array(*[F.lit(p << 24) + F.shiftleft(f"i{i}", 12) + F.col(f"i{j}") for p, (i, j) in enumerate(pairs)])
    rows = own.select(F.explode(keys.cast("array<long>")).alias("key"), "node", "component", "size", "x", "y")
    return rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node")


def _near(left: np.ndarray, right: np.ndarray, rows: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(bits, whether they are candidates) of the places `left` and `right` of some rows.

    Sets whose sizes have a ratio below `least` cannot be that similar.
    """
    size, component = rows["size"], rows["component"]
    x, y = rows["x"].view(np.uint64), rows["y"].view(np.uint64)
    bits = np.bitwise_count(x[left] ^ x[right]) + np.bitwise_count(y[left] ^ y[right])
    a, b = size[left], size[right]
    return bits, (bits <= MOST_BITS) & (np.minimum(a, b) >= least * np.maximum(a, b)) & (component[left] != component[right])


def candidates(rows: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bits) of the candidate pairs of whole buckets, sorted by key."""
    key = rows["key"]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(head, len(key)))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
    # Small buckets all at once, a distance at a time; large ones row by row.
    small = np.repeat(size <= 64, size)
    at, d = np.flatnonzero(small), 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        bits, near = _near(at, at + d, rows, least)
        out.append((at[near], at[near] + d, bits[near]))
        d += 1
    for first, n in zip(head[size > 64], size[size > 64], strict=True):
        for i in range(first, first + n - 1):
            other = np.arange(i + 1, first + n)
            bits, near = _near(np.full(len(other), i), other, rows, least)
            out.append((np.full(int(near.sum()), i), other[near], bits[near]))
    i, j, bits = map(np.concatenate, zip(*out, strict=True))
    return i, j, bits.astype(np.int32)


def _nearest(i: np.ndarray, j: np.ndarray, bits: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, nearest other node, bits) of each node of some candidate pairs."""
    one, two, far = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([bits, bits])
    order = np.lexsort((node[two], far, node[one]))
    own = node[one][order]
    first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    return own[first], node[two][order][first], far[order][first]


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least place of n that each is joined with by the pairs (i, j), directly or by a chain."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def in_buckets(rows: DataFrame, least: float, nearest: bool) -> DataFrame:
    """(key, a, b, bits) from the candidate pairs of the `keyed` rows: with `nearest` each node's nearest in a bucket.

    Otherwise links that join what hangs together in a bucket. A bucket that ends with its task, or is larger than
    TILE, isn't compared as a whole: its rows come with their key, b and bits null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "component", "size", "x", "y"]
        held: dict[str, np.ndarray] | None = None
        opened = None  # the key of the bucket that is not whole

        def close(rows: dict[str, np.ndarray], cut: int | None) -> pa.RecordBatch:
            i, j, bits = candidates(rows, least)
            node = rows["node"]
            if nearest:
                a, b, bits = _nearest(i, j, bits, node)
            else:
                first = _stars(i, j, len(node))
                own = np.flatnonzero(first != np.arange(len(node)))
                a, b = np.unique(np.stack([node[first[own]], node[own]]), axis=1)
                bits = np.zeros(len(a), np.int32)
            whole = np.zeros(0, np.int64) if cut is None else np.flatnonzero(rows["key"] == cut)
            n, m = len(a), len(whole)
            key = pa.array(np.concatenate([np.zeros(n, np.int64), rows["key"][whole]]), mask=np.arange(n + m) < n)
            b = pa.array(np.concatenate([b, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n)
            bits = pa.array(np.concatenate([bits, np.zeros(m, np.int32)]).astype(np.int32), mask=np.arange(n + m) >= n)
            return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([a, node[whole]])), b, bits], ["key", "a", "b", "bits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
            if held is None:
                opened = int(new["key"][0])  # the first bucket may have begun in another task
                held = new
            else:
                held = {c: np.concatenate([held[c], new[c]]) for c in names}
            last = int(np.searchsorted(held["key"], held["key"][-1]))
            if last:
                yield close({c: v[:last] for c, v in held.items()}, opened)
                held, opened = {c: v[last:] for c, v in held.items()}, None
            while len(held["key"]) > TILE:
                opened = int(held["key"][0])
                yield close({c: v[:TILE] for c, v in held.items()}, opened)
                held = {c: v[TILE:] for c, v in held.items()}
        if held is not None:
            yield close(held, int(held["key"][-1]))  # the last one may go on in another task

    return rows.mapInArrow(tidy(run), "key long, a long, b long, bits int")


def in_blocks(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links between components of a block that join all that any candidate pair of the block can join.

    `rows` (block, node, component, size, x, y, shingles) are dealt out in tiles by a digest of the node, and each two
    tiles of a block meet. A pair whose components a link has joined within the tile isn't compared again.
    """
    size = rows.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("component").alias("low"), F.max("component").alias("high"))
    tiles = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all") * 8 / BLOCK_BYTES))
    of = materialize(size.where("low < high").select("block", F.greatest(tiles, F.lit(1)).alias("tiles")))
    rows = rows.join(of, "block").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    rows = rows.withColumn("other", other).select("*", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"))

    def compared(tile: pa.Table) -> pa.Table:
        got = {c: tile.column(c).to_numpy() for c in ("node", "component", "size", "x", "y", "slot")}
        sets = [np.frombuffer(b, np.uint64) for b in tile.column("shingles").to_pylist()]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        here = np.flatnonzero(got["slot"] == got["slot"].min())
        there = np.flatnonzero(got["slot"] == got["slot"].max())
        alike = got["slot"].min() == got["slot"].max()
        out = []
        for k in here:
            others = there[there > k] if alike else there
            bits, near = _near(np.full(len(others), k), others, got, least)
            for m in others[near][np.argsort(bits[near], kind="stable")]:
                a, b = find(int(got["component"][k])), find(int(got["component"][m]))
                if a != b and _jaccard(sets[k], sets[m]) >= least:
                    root[a] = b
                    out.append((min(got["node"][k], got["node"][m]), max(got["node"][k], got["node"][m])))
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    rows = rows.select("block", "i", "j", "node", "component", "size", "x", "y", "slot", "shingles")
    return rows.groupBy("block", "i", "j").applyInArrow(compared, "a long, b long")


def _sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, shingles) of `nodes` (node, first), written: the sets of shingles of their texts, as bytes."""
    texts = docs.select(F.col(id_col).alias("first"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = marked(texts, nodes, "first").where("_maybe").join(nodes.select("node", "first"), "first").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column(1))
            sets = [shingle_set(data[i:j], words) for i, j in zip(at[:-1], at[1:], strict=True)]
            # Rows that repeat an id may differ in text; the one whose shingles make the node is meant.
            meant = np.array([_node_of(s) for s in sets], np.uint64).view(np.int64) == batch.column(0).to_numpy(zero_copy_only=False)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])
            yield out.filter(pa.array(meant, pa.bool_()))

    return materialize(texts.mapInArrow(tidy(run), "node long, shingles binary").dropDuplicates(["node"]))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The `pairs` (a, b) of nodes whose sets of shingles have `least` similarity, written."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [[np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(k)] for k in (2, 3)]
            keep = [_jaccard(x, y) >= least for x, y in zip(*of, strict=True)]
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(compared), "a long, b long"))


def links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """(a, b): links of `least` similarity that join all nodes whom the pairs that share a key can join."""
    found = materialize(in_buckets(keyed(nodes.withColumn("component", F.col("node"))), least, True))
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct()
    live = materialize(nodes.join(ends, "node", "left_semi"))
    sets = _sets(live, docs, id_col, text_col, words)
    # A row for each key of a node at most.
    pairs = found.where("b IS NOT NULL").groupBy("a").agg(F.array_sort(F.collect_set(F.struct("bits", "b"))).alias("all"))
    pairs = pairs.select("a", F.explode(F.slice("all", 1, NEAREST)).alias("to"))
    near = verified(pairs.select(F.least("a", "to.b").alias("a"), F.greatest("a", "to.b").alias("b")).distinct(), sets, least)
    joined = components(near)
    live = live.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    live = materialize(live)
    left = materialize(in_buckets(keyed(live), least, False))
    cut = left.where("key IS NOT NULL")
    cut = cut.join(cut.groupBy("key").agg(F.min("a").alias("least")), "key").select(F.col("least").alias("a"), F.col("a").alias("b"))
    within = live.select(F.col("component").alias("a"), F.col("node").alias("b"))
    edges = left.where("b IS NOT NULL").select("a", "b").unionByName(cut)
    # A component counts as one: its nodes are in one block.
    blocks = components(edges.unionByName(within)).withColumnRenamed("component", "block")
    rows = live.select("node", "component", "size", "x", "y").join(materialize(blocks), "node").join(sets, "node")
    more = materialize(in_blocks(rows, least))
    discard(found, left, sets)
    return near.unionByName(more)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(id, group): documents with others of `least` similarity, directly or by a chain; `group` is the least id.

    Texts with the same set of shingles are one node, so copies are never paired; texts without words are one
    node as well. Of the texts that share a key all are joined, compared shingle by shingle, or out of the question by
    MOST_BITS or sizes. Pairs that share no key are missed: at a similarity of 0.8 about one in twenty. Documents
    with a null id stand alone. An empty table gives an empty one.
    """
    known = materialize(prints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, words))
    same = [F.max(c).alias(c) for c in ("size", "x", "y", "c0", "c1", "c2", "c3")]
    nodes = materialize(known.groupBy("node").agg(F.min("id").alias("first"), *same))
    joined = components(links(nodes, docs, id_col, text_col, words, least))
    grouped = nodes.join(joined, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    groups = grouped.groupBy("component").agg(F.min("first").alias("group"))
    of_node = materialize(grouped.join(groups, "component").select("node", "group"))
    return known.join(of_node, "node").select(F.col("id").alias(id_col), "group")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """`docs` with one document of each group of near copies, that of the least id.

    Rows that share an id stay or go together; rows with a null id stay.
    """
    gone = near_copies(docs, id_col, text_col, words, least).where(F.col(id_col) != F.col("group")).select(id_col).distinct()
    return without(docs, materialize(gone), id_col)
