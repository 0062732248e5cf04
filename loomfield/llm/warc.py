"""WARC archives in Zstandard: one frame a record, and the dictionary in the leading skippable frame.

Writing and reading are maps over rows; an archive is closed at a bounded size, which bounds memory. Each
task attempt writes files of its own names and returns them, and only the files of attempts that ended
well are in the manifest that the reader follows, so a lost executor or a repeated task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import materialize, scratch

#: Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
#: Payload bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 2 << 20
MOST_SAMPLES = 2000
#: All pages bear one date, so that an archive depends on its rows alone.
DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal, as a column: four characters for five digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def quad(i: Column) -> Column:
        bits = F.conv(F.substring(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(letters, F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), quad), "")


def record(kind: str, key: str, url: str, payload: bytes | None, length: int, payload_digest: str, refers_to: str | None) -> bytes:
    """One record. A revisit's block has the HTTP headers of the response, its full length too, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    if kind == "response":
        block += payload
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{key}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if kind == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    fields["Content-Length"] = str(len(block))
    head = b"".join(f"{k}: {v}".encode() + _CRLF for k, v in fields.items())
    return VERSION + _CRLF + head + _CRLF + block + _CRLF + _CRLF


def _dictionary(records: list[bytes]):
    """A dictionary from the first records; of their plain bytes where there are too few to train on."""
    import zstandard

    samples, size = [], 0
    for item in records[:MOST_SAMPLES]:
        samples.append(item[: 64 << 10])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    import zstandard

    trained = _dictionary(records)
    body = trained.as_bytes()
    pack = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(body)) + body + b"".join(map(pack.compress, records))


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends, from its headers of frame and blocks."""
    if len(data) < at + 5 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    size_field = (1 if single else 0, 2, 4, 8)[flags >> 6]
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + size_field
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut short")
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut short")
    return at


def frames(data: memoryview) -> Iterator[bytes]:
    """Each frame of an archive, decoded with the dictionary of the leading skippable frame if it has one."""
    import zstandard

    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data, 0)[0] == SKIPPABLE_DICTIONARY:
        size = struct.unpack_from("<I", data, 4)[0]
        body = bytes(data[8 : 8 + size])
        if len(body) != size:
            raise ValueError("the dictionary is cut short")
        if len(body) >= 4 and struct.unpack_from("<I", body)[0] == FRAME_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body)
        trained, at = zstandard.ZstdCompressionDict(body), 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(data):
        end = frame_end(data, at)
        yield unpack.decompress(data[at:end])
        at = end


def parse(item: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; ValueError unless version, required fields, lengths and digests hold."""
    head, gap, rest = item.partition(_CRLF + _CRLF)
    lines = head.split(_CRLF)
    if not gap or lines[0] != VERSION:
        raise ValueError("not a WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header without a colon")
        fields[name.decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"a record without {name}")
    length = int(fields["content-length"])
    block = rest[:length]
    if rest[length:] != _CRLF + _CRLF or len(block) != length:
        raise ValueError("a record's length isn't its Content-Length")
    if fields.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("a block doesn't have its digest")
    return fields, block


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Writes archives of `pages` into `folder`; returns the manifest (name, n_records, n_bytes).

    Of rows with equal payloads of `min_payload` bytes or more, the one with the largest id is the
    response and the others revisit it; rows that share that largest id are responses all. A null payload
    is empty, a null url is an empty one, and a null id is that of the record `<urn:page:>`.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("key"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    equal = rows.where(F.col("size") >= min_payload).groupBy("sha1").agg(F.max("key").alias("last"), F.count("*").alias("n"))
    equal = materialize(equal.where("n > 1 and last is not null").select(F.col("sha1").alias("same"), "last"))
    rows = rows.join(equal, F.col("sha1") == F.col("same"), "left").select(
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"),
        "url",
        "size",
        base32(F.col("sha1")).alias("digest"),
        F.when(~F.col("key").eqNullSafe(F.col("last")), F.col("last").cast("string")).alias("refers_to"),
        "payload",
    )
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            name, body = f"part-{uuid.uuid4().hex}.warc.zst", archive(held)
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(body)
            done = pa.RecordBatch.from_pydict({"name": [name], "n_records": [len(held)], "n_bytes": [len(body)]})
            held.clear()
            return done

        size = 0
        for batch in batches:
            for key, url, length, sha1, to, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(record("revisit" if to is not None else "response", key, url, body, length, sha1, to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    size = 0
        if held:
            yield close()

    return materialize(rows.mapInArrow(run, "name string, n_records long, n_bytes long"))


def read(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """(record_id, record_type, refers_to, url, payload_bytes, payload_digest[, payload]) of all records.

    A manifest limits it to the files of committed attempts. A malformed record fails the job. The payload
    length of a revisit is that of its HTTP headers; its payload is null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if manifest is not None:
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select("name"), "name", "left_semi")
    names = ["record_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest"] + ["payload"] * payloads

    def row(item: bytes) -> tuple:
        fields, block = parse(item)
        head, _, body = block.partition(_CRLF + _CRLF)
        length = next(int(x.split(b":")[1]) for x in head.split(_CRLF) if x.lower().startswith(b"content-length:"))
        sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        if kind == "response" and (len(body) != length or digest(body) != sha1):
            raise ValueError("a payload doesn't have its length and digest")
        inner = lambda name: fields[name][1:-1].removeprefix("urn:page:") if name in fields else None
        out = inner("warc-record-id"), kind, inner("warc-refers-to"), fields.get("warc-target-uri"), length, sha1
        return (*out, body if kind == "response" else None) if payloads else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(map(row, frames(memoryview(batch.column(0)[k].as_buffer()).cast("B"))))
                columns = list(zip(*rows, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    kinds = "record_id string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string"
    return files.select("content").mapInArrow(run, kinds + ", payload binary" * payloads)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Writes `pages` to archives in the shared folder and reads them back, without payloads.

    An empty table writes no archive and gives no rows.
    """
    folder = scratch(pages.sparkSession)
    manifest = write(pages, folder, id_col, url_col, payload_col, min_payload)
    if manifest.isEmpty():
        fields = "record_id string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string"
        return pages.sparkSession.createDataFrame([], fields)
    return read(pages.sparkSession, folder, manifest, payloads=False)
