"""Ogg media columns.

``encode`` stores a payload as the packets of two interleaved logical streams in one
physical Ogg bitstream; ``decode`` is a general reader: it verifies page checksums,
reassembles packets from lacing values across pages, demultiplexes logical streams by
serial number and derives timestamps from granule positions.

Defined results: null and empty texts store one block of 576 bytes of 255. A text of any
length is stored whole. Equal texts give equal bytes (serial numbers come from the
payload's length, never from the row). Repeated rows give repeated results, an empty table
an empty result, and further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm.rows import map_rows, texts

UNIT = 576
#: Samples in a data packet: not a multiple of what a page holds, so that packets cross pages.
PACKET = 8 * UNIT
RATE = 48_000
STREAMS = 2
MAGIC = b"RunLnsPC"
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A bitstream that breaks the container's rules."""


def ogg_crc(data: bytes) -> int:
    """Ogg's checksum (polynomial 0x04c11db7, most significant bit first, start 0, no final xor).

    zlib has the same polynomial least significant bit first, so the bits of every byte are
    reversed on the way in and those of the result on the way out.
    """
    crc = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def pad(data: bytes, unit: int = UNIT) -> bytes:
    size = max(1, -(-len(data) // unit)) * unit
    return data + b"\xff" * (size - len(data))


def page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqII", b"OggS", 0, flags, granule, serial, sequence)
    tail = bytes([len(lacing)]) + lacing + body
    crc = ogg_crc(head + b"\0\0\0\0" + tail)
    return head + struct.pack("<I", crc) + tail


class StreamWriter:
    """Pages of one logical stream: packets are laced and may continue on the next page."""

    def __init__(self, serial: int):
        self.serial, self.sequence, self.lacing, self.body = serial, 0, bytearray(), []
        self.granule, self.flags, self.out = -1, FIRST, []

    def packet(self, data: bytes, granule: int) -> None:
        lacing, at = b"\xff" * (len(data) // 255) + bytes([len(data) % 255]), 0
        while lacing:
            take = lacing[: 255 - len(self.lacing)]
            size = sum(take)
            self.lacing += take
            self.body.append(data[at : at + size])
            at, lacing = at + size, lacing[len(take) :]
            if not lacing:
                self.granule = granule
            if len(self.lacing) == 255:
                self.flush(CONTINUED if lacing else 0)

    def flush(self, following: int = 0, last: bool = False) -> None:
        if not self.lacing and not last:
            self.flags |= following
            return
        self.out.append(page(self.serial, self.sequence, self.granule, self.flags | (LAST if last else 0), bytes(self.lacing), b"".join(self.body)))
        self.sequence, self.lacing, self.body, self.granule, self.flags = self.sequence + 1, bytearray(), [], -1, following


def encode(payload: bytes, packet: int = PACKET, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """One bitstream of ``streams`` logical streams; packet i goes to stream i mod ``streams``."""
    writers = [StreamWriter((len(payload) * streams + i) & 0xFFFFFFFF) for i in range(streams)]
    for i, w in enumerate(writers):
        w.packet(MAGIC + struct.pack("<BBHIQ", i, streams, 8, rate, len(payload)), 0)
        w.flush()
    done = [0] * streams
    for i, at in enumerate(range(0, len(payload), packet)):
        data = payload[at : at + packet]
        done[i % streams] += len(data)
        writers[i % streams].packet(data, done[i % streams])
    for w in writers:
        w.flush(last=True)
    pages = [w.out[0] for w in writers]  # all first pages stand before any other
    rest = [w.out[1:] for w in writers]
    for i in range(max(map(len, rest))):
        pages += [r[i] for r in rest if i < len(r)]
    return b"".join(pages)


@dataclass
class Logical:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position of the page on which each packet ends, where it is the last to end there.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    continued_pages: int = 0
    begun: list[bytes] = field(default_factory=list)
    ended: bool = False
    next_page: int = 0

    def samples(self) -> int:
        return max([0, *self.granules])


def decode(media: bytes) -> dict[int, Logical]:
    """All logical streams of a bitstream; raises OggError on damage."""
    found: dict[int, Logical] = {}
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, count = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + count]
        start = at + 27 + count
        end = start + sum(lacing)
        if version or end > len(media) or len(lacing) < count:
            raise OggError(f"cut or unknown page at byte {at}")
        if ogg_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum differs on the page at byte {at}")
        stream = found.setdefault(serial, Logical(serial))
        if bool(flags & FIRST) != (stream.pages == 0) or sequence != stream.next_page or stream.ended:
            raise OggError(f"page {sequence} of stream {serial} is out of order")
        if bool(flags & CONTINUED) != bool(stream.begun):
            raise OggError(f"page {sequence} of stream {serial} doesn't continue its packet")
        stream.pages, stream.next_page, stream.ended = stream.pages + 1, sequence + 1, bool(flags & LAST)
        stream.continued_pages += bool(flags & CONTINUED)
        before, run = len(stream.packets), 0
        for size in lacing:
            run += size
            if size < 255:
                stream.packets.append(b"".join([*stream.begun, media[start : start + run]]))
                stream.begun, start, run = [], start + run, 0
        if run or (lacing and lacing[-1] == 255):
            stream.begun.append(media[start : start + run])
        ended = len(stream.packets) - before
        stream.granules += [-1] * max(0, ended - 1) + [granule] * (ended > 0)
        at = end
    for stream in found.values():
        if stream.begun or not stream.ended:
            raise OggError(f"stream {stream.serial} doesn't end")
    return found


def timestamps(stream: Logical, rate: int = RATE) -> list[int]:
    """Microseconds at which each data packet ends, from the granule positions of the stream's pages.

    A page's granule position is the end of the last packet that ends on it. Packets before that one on the
    page end where the one after them begins (one sample a byte); a stream may begin at any sample. Where
    two pages don't meet, or the last packet has no position, the stream is damaged.
    """
    ends, at = [], None
    for data, granule in zip(reversed(stream.packets[1:]), reversed(stream.granules[1:]), strict=True):
        if granule >= 0 and at is not None and granule != at:
            raise OggError(f"granule position {granule} where the next packet begins at {at}")
        at = granule if granule >= 0 else at
        if at is None or at < len(data):
            raise OggError("packets without a granule position, or before the first sample")
        ends.append(at * 1_000_000 // rate)
        at -= len(data)
    return ends[::-1]


def read_payload(media: bytes) -> tuple[bytes, str]:
    """The stored payload, joined from the demultiplexed streams, and its feature string."""
    streams: dict[int, Logical] = {}
    for s in decode(media).values():
        head = s.packets[0]
        if head[:8] != MAGIC:
            raise OggError("unknown codec")
        index, count, _, rate, total = struct.unpack("<BBHIQ", head[8:24])
        streams[index] = s
    if len(streams) != count:
        raise OggError("a logical stream is missing")
    data = [streams[i].packets[1:] for i in range(count)]
    payload = b"".join(data[i % count][i // count] for i in range(sum(map(len, data))))
    if len(payload) != total:
        raise OggError(f"{len(payload)} of {total} samples")
    ends = [timestamps(streams[i], rate) for i in range(count)]
    zero = payload.count(0xFF)
    feature = (
        f"rate={rate};samples={len(payload)};streams={count};pages={sum(s.pages for s in streams.values())}"
        f";continued={sum(s.continued_pages for s in streams.values())};packets={sum(map(len, data))}"
        f";end_us={'/'.join(str(e[-1]) if e else '0' for e in ends)};full_scale={zero};adler={zlib.adler32(payload)}"
    )
    return payload, feature


SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_us bigint"


def store(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store every text as Ogg and read it back; ``keep_media`` adds the stored bytes as ``media``."""

    def run(batch: pa.RecordBatch) -> list:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            media = encode(pad(raw))
            payload, feature = read_payload(media)
            row = (doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(payload) * 1_000_000 // RATE)
            rows.append(row + ((media,) if keep_media else ()))
        return list(map(list, zip(*rows, strict=True)))

    return map_rows(texts(docs), run, SCHEMA + (", media binary" if keep_media else ""))
