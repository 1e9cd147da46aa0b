"""SentencePiece encoding that keeps offsets, and decoding.

``Normalizer`` applies a model's compiled character map by longest prefix and records, for
every normalised byte, the original byte it came from. ``Encoder`` encodes the normalised
text and projects every piece to its span of original bytes.

Ids equal those of the sentencepiece library. Where the vocabulary proves it safe (no piece
holds the space mark after another character, none holds a newline with others), the
normalised text is cut before runs of the mark and around newlines, and the library encodes
each distinct segment once; merges can't cross such a cut. Other models are encoded whole.

Defined results: a null or empty text has no ids and decodes to the empty text; texts of any
length are encoded whole; equal texts have equal ids; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from runlens.llm.rows import map_rows, texts

MARK = "▁"
#: Distinct segments kept by a worker; the cache is emptied beyond it, which only costs time.
CACHE_SEGMENTS = 400_000


class PrefixMap:
    """The compiled character map: a double-array trie over UTF-8 keys and a pool of replacements.

    Layout (public format): 32-bit size of the trie, its units, then zero-terminated replacements.
    """

    def __init__(self, blob: bytes):
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.pool = blob[4 + size :]
        else:
            self.units, self.pool = [], b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed and their replacement for the longest key that starts at ``at``."""
        units, best = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        pos = offset(units[0])
        for i in range(at, len(data)):
            c = data[i]
            pos ^= c
            u = units[pos]
            if (u & ((1 << 31) | 0xFF)) != c:
                break
            pos ^= offset(u)
            if (u >> 8) & 1:
                best = (i + 1 - at, units[pos] & 0x7FFFFFFF)
        if best is None:
            return None
        length, value = best
        return length, self.pool[value : self.pool.index(b"\0", value)]


class Normalizer:
    """Normalised bytes and, for each, the original byte offset it stems from."""

    def __init__(self, charsmap: bytes, add_dummy_prefix: bool, remove_extra_whitespaces: bool, escape_whitespaces: bool = True):
        self.map = PrefixMap(charsmap)
        self.prefix, self.squeeze, self.escape = add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces
        self.space = MARK.encode() if escape_whitespaces else b" "

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        raw = text.encode("utf-8")
        if not raw:
            return b"", np.zeros(1, np.int64)
        source = np.frombuffer(raw, np.uint8)
        if self.map.units:
            norm, origin = self._mapped(raw)
        else:
            norm, origin = raw, np.arange(len(raw), dtype=np.int64)
        if self.squeeze:
            b = np.frombuffer(norm, np.uint8)
            is_space = b == 32
            keep = ~is_space | ~np.concatenate([[True], is_space[:-1]])
            if is_space.size and is_space[-1]:
                keep[len(b) - len(norm) + len(norm.rstrip(b" ")) :] = False
            norm, origin = b[keep].tobytes(), origin[keep]
        if self.prefix and norm:
            norm, origin = b" " + norm, np.concatenate([origin[:1], origin])
        if self.escape:
            counts = np.where(np.frombuffer(norm, np.uint8) == 32, len(self.space), 1)
            norm, origin = norm.replace(b" ", self.space), np.repeat(origin, counts)
        return norm, np.append(origin, len(source))

    def _mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        out, origin, at = [], [], 0
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit:
                size, new = hit
            else:
                size = 1
                while at + size < len(raw) and raw[at + size] & 0xC0 == 0x80:
                    size += 1
                new = raw[at : at + size]
            out.append(new)
            origin += [at] * len(new) if hit else range(at, at + size)
            at += size
        return b"".join(out), np.array(origin, np.int64)


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            blob = f.read()
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = {}
        for number, value in _fields(blob):
            if number == 3:  # normaliser: 2 character map, 3 dummy prefix, 4 remove spaces, 5 escape
                spec = dict(_fields(value))
        self.normalize = Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        n = self.lib.get_piece_size()
        pieces = [self.lib.id_to_piece(i) for i in range(n)]
        self.sizes = np.array([1 if self.lib.is_byte(i) else len(p.encode("utf-8")) for i, p in enumerate(pieces)], np.int64)
        self.unknown = self.lib.unk_id()
        inner = re.compile(f"[^{MARK}]{MARK}|.\n|\n.", re.S)
        self.splits = self.normalize.prefix and not self.normalize.squeeze and not self.normalize.map.units and not any(inner.search(p) for p in pieces) and self.unknown not in self.lib.encode("\n\u0001\U0010fffd")
        self.cache: dict[str, tuple[int, ...]] = {}

    #: A run of marks with what follows it up to the next mark or newline, a newline, or other text.
    _SEGMENT = re.compile(r"\n| *[^ \n]+| +")

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.splits or MARK in text:
            return self.lib.encode(text, num_threads=1)
        cache = self.cache
        segments = self._SEGMENT.findall(" " + text)
        new = list({s for s in segments if s not in cache})
        if new:
            if len(cache) + len(new) > CACHE_SEGMENTS:
                cache.clear()
                new = list(set(segments))
            # With a leading space the library's own dummy prefix stands for it; other segments follow a newline, whose ids are cut off.
            head = [s[0] == " " for s in new]
            got = self.lib.encode([s[1:] if h else "\n" + s for s, h in zip(new, head, strict=True)], num_threads=1)
            bare = len(self.lib.encode("\n", num_threads=1))
            for s, h, ids in zip(new, head, got, strict=True):
                # The mark alone has no text for the library to prefix.
                cache[s] = tuple(ids if h and len(s) > 1 else self._mark_only() if h else ids[bare:])
        out: list[int] = []
        for s in segments:
            out += cache[s]
        return out

    def _mark_only(self) -> list[int]:
        return self.lib.encode("\n", num_threads=1)[:1]

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and, for each, the [start, end) of the original bytes it covers (an n x 2 array)."""
        ids = self.ids(text)
        if not ids:
            return ids, np.zeros((0, 2), np.int64)
        norm, origin = self.normalize(text)
        known = np.asarray(ids)
        ends = np.cumsum(self.sizes[known])
        if self.unknown in ids or ends[-1] != len(norm):
            ends = self._surface_ends(norm)
        starts = np.concatenate([[0], ends[:-1]])
        return ids, np.stack([origin[starts], origin[ends]], 1)

    def _surface_ends(self, norm: bytes) -> np.ndarray:
        """Ends of pieces where an unknown piece stands for text of its own length."""
        proto = self.lib.encode(norm.decode("utf-8").removeprefix(MARK).replace(MARK, " "), out_type="immutable_proto")
        sizes = [1 if self.lib.is_byte(p.id) else len(p.piece.encode("utf-8")) for p in proto.pieces]
        return np.cumsum(np.array(sizes, np.int64))

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """Per document the digests of its ids and of the decoded text, and of the projected spans.

    ``covered_bytes`` counts the original bytes under the spans; ``spans_crc32`` is the checksum
    of the starts and ends as little-endian 64-bit integers.
    """
    def run(batch: pa.RecordBatch) -> list:
        enc = encoder(model)
        names = enc.__dict__.setdefault("decimal", [str(i) for i in range(len(enc.sizes))])
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids, spans = enc.encode(text)
            covered = int((spans[:, 1] - np.maximum.accumulate(np.concatenate([[0], spans[:-1, 1]]))).clip(0).sum()) if ids else 0
            rows.append((doc_id, len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(enc.decode(ids).encode("utf-8")).hexdigest(), covered, zlib.crc32(np.ascontiguousarray(spans, "<i8").tobytes())))
        return list(map(list, zip(*rows, strict=True)))

    return map_rows(texts(docs), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint, spans_crc32 bigint")
