"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Archives are written by Spark's own text writer, so that they reach any file system that Spark does, and a lost task
leaves nothing behind: a record's frame is a row, and the separator of rows is an empty skippable frame, which readers
pass over. The reader finds each frame's extent from its block headers, decodes it with the dictionary, and validates
the record's headers, lengths and digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, written

#: Magic number of the skippable frame that holds a dictionary, and of a frame of data.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame; it is ASCII, as a row separator has to be.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
DICTIONARY_BYTES = 32 << 10
#: Rows that a dictionary is trained on, at most, and the longest payload that is used for it.
DICTIONARY_ROWS, DICTIONARY_TEXT = 256, 64 << 10
#: Bytes of payload in an archive, about. An archive is written and read by one task.
ARCHIVE_BYTES = 16 << 20
#: Records with equal payloads of at least so many bytes are one response and revisits of it.
MIN_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that is not as it should be."""


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Frames


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends: a skippable frame, or one of data, by its block headers."""
    if len(data) - at < 8:
        raise WarcError(f"{len(data) - at} bytes left at {at}: no frame")
    magic, size = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + size
    elif magic == FRAME_MAGIC:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if end + 3 > len(data):
                raise WarcError(f"a frame at {at} breaks off")
            header = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(header & 1), header >> 1 & 3, header >> 3
            if kind == 3:
                raise WarcError(f"a frame at {at} has a reserved block")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    else:
        raise WarcError(f"no frame at {at}")
    if end > len(data):
        raise WarcError(f"a frame at {at} breaks off")
    return end


def frames(archive: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, which begins with its dictionary; empty skippable frames are passed over."""
    data, at, decoder = memoryview(archive), 0, None
    while at < len(data):
        end = frame_end(data, at)
        (magic,) = struct.unpack_from("<I", data, at)
        if decoder is None:
            if magic != DICTIONARY_MAGIC:
                raise WarcError("the leading frame holds no dictionary")
            raw = bytes(data[at + 8 : end])
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                raw = zstandard.ZstdDecompressor().decompress(raw)
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
        elif magic == FRAME_MAGIC:
            try:
                yield decoder.decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise WarcError(f"the frame at {at} can't be decoded: {e}") from e
        at = end


# Records


def _head(lines: list[str]) -> bytes:
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _uri(text: str | None) -> str:
    return "".join(c for c in text or "" if c not in "\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with the payload, or a revisit without it."""
    http = _head(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"])
    block = http if revisit else http + payload
    name = "none" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {_DATE}"]
    lines += [f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return _head([*lines, f"Content-Length: {len(block)}"]) + block + b"\r\n\r\n"


def _fields(head: bytes, what: str) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in out:
            raise WarcError(f"{what} header {line!r}")
        out[name.lower()] = value.strip()
    return first, out


def _number(fields: dict[str, str], name: str) -> int:
    if not (value := fields.get(name, "")).isdigit():
        raise WarcError(f"{name} is {value!r}")
    return int(value)


def _page(uri: str) -> int | None:
    if not (uri.startswith("<urn:page:") and uri.endswith(">")):
        raise WarcError(f"{uri!r} is no page's id")
    return None if uri[10:-1] == "none" else int(uri[10:-1])


def parse(data: bytes) -> dict[str, object]:
    """A record's fields; WarcError if a header, a length or the digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, fields = _fields(head, "WARC")
    if not found or version != "WARC/1.1":
        raise WarcError(f"version {version!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest", "content-type"):
        if name not in fields:
            raise WarcError(f"no {name}")
    kind, size = fields["warc-type"], _number(fields, "content-length")
    if kind not in ("response", "revisit"):
        raise WarcError(f"type {kind!r}")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {size}, the block has {len(rest) - 4} bytes")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    status, http_fields = _fields(http, "HTTP")
    if not found or not status.startswith("HTTP/1."):
        raise WarcError(f"status line {status!r}")
    length = _number(http_fields, "content-length")
    algorithm, _, value = fields["warc-payload-digest"].partition(":")
    if algorithm != "sha1" or len(value) != 32:
        raise WarcError(f"digest {value!r}")
    refers_to = None
    if kind == "response":
        if len(payload) != length or digest(payload) != value:
            raise WarcError("the payload's length or digest differs from its header")
    else:
        if payload or fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields:
            raise WarcError("a revisit with a payload, or without profile or response")
        refers_to = _page(fields["warc-refers-to"])
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": kind, "payload_bytes": length,
        "payload_digest": value, "refers_to": refers_to, "payload": payload if kind == "response" else None,
    }


# Spark


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from at most DICTIONARY_ROWS payloads; empty if they are too few or too small to train one."""
    rows = pages.select(F.col(html_col).cast("string").alias("h")).where(F.octet_length("h").between(1, DICTIONARY_TEXT)).limit(DICTIONARY_ROWS).collect()
    samples = [r["h"].encode() for r in rows]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def assign(keys: DataFrame) -> DataFrame:
    """id, sha1, refers_to of the records that are revisits. keys: id, sha1, size of each row's payload.

    Only ids and digests are shuffled. The last id of a digest is an aggregate, so a payload that very many pages have is
    added up before it is shuffled; the join back to its rows is one that adaptive execution splits. An id on several
    rows is judged payload by payload.
    """
    last = keys.where(F.col("id").isNotNull() & (F.col("size") >= MIN_REVISIT_BYTES)).groupBy("sha1").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1")
    return keys.join(last, "sha1").where("id < last").select("id", "sha1", F.col("last").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for each row, in archives under path, which must not exist.

    Of rows with equal payloads those with the largest id are responses, the others revisits of it; rows with one id and
    different payloads are told apart by their payloads. Null html is an empty payload, a null url an empty one; a null id is
    written as `none`, and is always a response. Repeated rows are each written. An empty table gives one archive with a
    dictionary only. Columns other than the three named are not read, whatever their names. The files are the text
    writer's, named part-*.txt; all of them are archives.
    """
    dictionary = train_dictionary(pages, html_col)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    keys = written(rows.select("id", "sha1", F.octet_length("html").alias("size")), "digests")
    revisits = assign(keys)
    archives = max(1, -(-(keys.agg(F.sum("size")).first()[0] or 0) // ARCHIVE_BYTES))
    joined = rows.repartition(archives, "id", "sha1").join(revisits, ["id", "sha1"], "left").select("id", "url", "html", "sha1", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=3, dict_data=given, write_checksum=True, write_content_size=True)
        out = [dictionary_frame(dictionary)]
        for batch in batches:
            for i, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(encoder.compress(record(i, url, html.encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, refers_to is not None)))
                if sum(map(len, out[-64:])) > 1 << 20 or len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("encoding", "UTF-8").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of every record under path."""
    names = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for frame in frames(archive.as_py()):
                    rows.append(parse(frame))
                    held += len(frame)
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in names.items()], names=list(names))
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in names.items()], names=list(names))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages written to archives in the scratch folder and read back, one row for each: see write_archives, read_archives."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    return read_archives(pages.sparkSession, path)
