"""Byte-level BPE encoding and decoding with a local rank file.

A long text is cut before encoding, at places where the splitting pattern always ends a match: before a
single space between two ASCII letters or digits. A letter or digit run never takes in white space and
the space always opens the next match, so the ids are those of the uncut text. Between such places a
text stays whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import tidy

LONG = 1 << 16
_CUT = re.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")


def pieces(text: str, most: int = LONG) -> Iterator[str]:
    """`text` in parts of about `most` characters that can be encoded one by one."""
    start = 0
    while len(text) - start > most:
        found = _CUT.search(text, start + most - 1)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def encoding(rank_file: str, pattern: str):
    """The codec, built once in a process: the library's own table of encodings holds it from one task to the next."""
    import tiktoken
    from tiktoken import registry

    name = f"{rank_file} {pattern}"
    if name not in registry.ENCODINGS:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return registry.ENCODINGS[name]


def encode_text(codec, text: str | None, most: int = LONG) -> list[int]:
    if not text:
        return []
    if len(text) <= most:
        return codec.encode_ordinary(text)
    return [i for part in pieces(text, most) for i in codec.encode_ordinary(part)]


def decode_ids(codec, ids: list[int]) -> bytes:
    """Raw bytes: ids may end inside a character, so nothing is decoded to text here."""
    return codec.decode_bytes(ids)


def encode(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False
) -> DataFrame:
    """Each row's `id_col`, `n_tokens`, `ids` (array<int>), `ids_sha256` and `decoded_sha256`.

    `digests_only` leaves `ids` out. Null and empty texts have no ids; repeated rows stay; other columns
    are not read. The rank file is read once in each Python worker, from a path that all hosts have. One
    map over the rows, without a shuffle; memory is that of a batch of texts and one text's ids.
    """
    schema = docs.select(id_col).schema
    names = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(rank_file, pattern)
        decimal = [b"%d" % i for i in range(codec.n_vocab)]
        for batch in batches:
            counts, id_sums, text_sums, ids_out = [], [], [], []
            for text in batch.column(1):
                ids = encode_text(codec, text.as_py())
                counts.append(len(ids))
                id_sums.append(hashlib.sha256(b" ".join([decimal[i] for i in ids])).hexdigest())
                text_sums.append(hashlib.sha256(decode_ids(codec, ids)).hexdigest())
                if not digests_only:
                    ids_out.append(pa.array(ids, pa.int32()))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            fields = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if not digests_only:
                flat = pa.concat_arrays(ids_out) if ids_out else pa.array([], pa.int32())
                ends = pa.array([0, *_running(counts)], pa.int32())
                out.append(pa.ListArray.from_arrays(ends, flat))
                fields.append("ids")
            yield pa.RecordBatch.from_arrays(out, fields)

    result = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        tidy(run), f"{id_col} {schema[0].dataType.simpleString()}, {names}"
    )
    return result


def _running(counts: list[int]) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total


def decode(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Each row's `id_col` and `bytes`, the raw bytes of its ids; null ids give no bytes."""
    kind = tokens.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(rank_file, pattern)
        for batch in batches:
            got = [decode_ids(codec, ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], [id_col, "bytes"])

    return tokens.select(id_col, ids_col).mapInArrow(tidy(run), f"{id_col} {kind}, bytes binary")
