"""WARC archives compressed with an embedded Zstandard dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself
a Zstandard frame, built from the records archived there; each record follows as a frame of
its own, so it can be read alone. Equal payloads are written once: the row with the largest
page_id is the response, the others are revisits that point to it.

Archives are rows of a table in the shared folder (no executor needs a path of another):
an archive is one binary value of bounded size, and one lost executor costs its tasks alone.

Defined results: a null html is an empty payload; payloads shorter than the least size for
de-duplication are all responses; a null page_id is written without an id and never referred
to unless its payload has no other row; repeated rows of one page_id are each written, with
the same type; texts of any length are written whole; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.scratch import Scratch

DICT_MAGIC = 0x184D2A5D
DICT_BYTES = 32 * 1024
#: Bytes and parts of records of an archive that its dictionary is trained on, at most.
TRAIN_BYTES, TRAIN_RECORDS = 1_500_000, 400
#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 32_000_000
MIN_DEDUP_BYTES = 0
#: Bytes handed to the decompressor at once.
FEED_BYTES = 8192
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of the HTTP message and no body."""
    name = "none" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; checks its length and block digest."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; too few or too small ones serve as raw content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"WARC/1.1"


def samples_of(records: list[bytes]) -> list[bytes]:
    """What the dictionary is trained on: all of a small archive, else parts at even distances over all its bytes.

    Every other part is the head of the record met there, the rest begin where they are met.
    """
    ends = list(itertools.accumulate(map(len, records)))
    if not records or ends[-1] <= TRAIN_BYTES and len(records) <= TRAIN_RECORDS:
        return [r[at : at + DICT_BYTES] for r in records for at in range(0, len(r), DICT_BYTES)]
    most, out = TRAIN_BYTES // TRAIN_RECORDS, []
    for i in range(TRAIN_RECORDS):
        place = ends[-1] * (2 * i + 1) // (2 * TRAIN_RECORDS)
        k = bisect.bisect_right(ends, place)
        at = 0 if i % 2 == 0 else max(0, min(place - (ends[k] - len(records[k])), len(records[k]) - most))
        out.append(records[k][at : at + most])
    return out


def build_archive(records: list[bytes]) -> bytes:
    raw = train(samples_of(records))
    packed = zstandard.ZstdCompressor(level=19).compress(raw)
    writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed + b"".join(map(writer.compress, records))


def read_archive(data: bytes):
    """(headers, block) of every record, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        one, plain = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("cut frame")
            plain.append(one.decompress(view[at : at + FEED_BYTES]))
            at += FEED_BYTES
        at = min(at, len(data)) - len(one.unused_data)
        yield parse(b"".join(plain))


def assign(pages: DataFrame, min_dedup_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """page_id, url, payload and the page_id its payload refers to (null for responses).

    Only ids and digests are grouped and joined by payload, partial sums first; pages are then
    joined by their own id, so a payload with a third of all rows gathers no html anywhere.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keys = rows.select("page_id", F.sha2("payload", 256).alias("key"), F.octet_length("payload").alias("n")).filter(F.col("n") >= min_dedup_bytes)
    best = keys.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1 and refers_to is not null")
    revisits = keys.join(best, "key").filter("page_id is null or page_id != refers_to").select("page_id", "refers_to", "key").distinct()
    named = revisits.filter("page_id is not null").select("page_id", "refers_to", "key")
    unnamed = revisits.filter("page_id is null").select(F.col("key").alias("k2"), F.col("refers_to").alias("r2"))
    out = rows.filter("page_id is not null").withColumn("key", F.sha2("payload", 256)).join(named, ["page_id", "key"], "left").select("page_id", "url", "payload", "refers_to")
    bare = rows.filter("page_id is null").join(unnamed, F.sha2("payload", 256) == F.col("k2"), "left").select("page_id", "url", "payload", F.col("r2").alias("refers_to"))
    return out.unionAll(bare)


def write(pages: DataFrame, min_dedup_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Archives of all pages: a table with the column ``archive``, in the shared folder."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(record(page_id, url, payload, refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([build_archive(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([build_archive(held)], pa.binary())], names=["archive"])

    return Scratch(pages.sparkSession, "warc").cut(assign(pages, min_dedup_bytes).mapInArrow(run, "archive binary"))


def read(archives: DataFrame) -> DataFrame:
    """One row per record of the archives; a revisit's payload length and digest come from its headers."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in read_archive(data.as_buffer()):
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(body) != length or digest(body) != found):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                    name, refers = fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To")
                    rows.append((None if name == "none" else int(name), length, found, fields["WARC-Type"], int(refers[10:-1]) if refers else None, fields["WARC-Target-URI"]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return archives.mapInArrow(run, schema)
