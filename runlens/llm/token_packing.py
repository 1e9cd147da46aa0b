"""Packing token sequences by best-fit decreasing.

Every document is tokenised and ends with a separator id. Overlong documents are first cut
into full windows; the remainders go, longest first, into the open window with the least
room that still takes them, found in a segment tree indexed by remaining room. Remainders are
dealt to shards by a hash of their row; the shards' number follows the rows, so no task grows
with the input, however often an id repeats, and each shard leaves at most a few windows open.

Padding is what a sequence lacks to ``capacity``, nothing where its length is a power of two.

Defined results: a null or empty text is one piece with the separator alone; a document's
pieces follow each other without gaps; rows that repeat a doc_id are packed each on their
own, and so are those without one; which sequence a piece is in may vary with the layout of the
input's files, the pieces never do; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.rows import map_rows, texts
from runlens.llm.scratch import Scratch

CAPACITY = 4096
END_ID = 2
#: Remainders a shard packs; a full shard takes seconds and some megabytes.
SHARD_PIECES = 20_000
#: Distinct words whose ids a worker keeps; beyond it the cache is emptied, which only costs time.
CACHE_WORDS = 300_000


#: Marks that end a word after a letter: tokenised on their own.
_FINAL_MARK = re.compile(r"[!-/:-@\[-`{-~](?<=[a-zß-öø-ÿ].)[!-/:-@\[-`{-~]*(?=[ \n]|\Z)")


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes, each distinct word tokenised once.

    Tokens never cross a space or a newline (white space is dropped before merging), so cutting
    there changes no id; nor do they join a letter to a following punctuation mark, or tell case.
    A file without these traits is run on whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {"": b""}
        encode = lambda t: self.lib.encode(t, add_special_tokens=False).ids
        probe = "Ab, b\nCé.  \n d'S; x!"
        pieces = ["ab", ",", "b", "cé", ".", "d's", ";", "x", "!"]
        self.splits = encode(probe) == [i for w in pieces for i in encode(w)] and not encode(" \n")
        size = self.lib.get_vocab_size()
        self.ends = np.array([(self.lib.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return [np.asarray(e.ids, "<u4").tobytes() for e in self.lib.encode_batch(texts, add_special_tokens=False)]
        words = [self._words(t) for t in texts]
        new = set().union(*words) - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {"": b""}
            new = set().union(*words)
        self._learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def _words(self, text: str) -> list[str]:
        """Parts whose ids follow each other; lower case and bare of final marks where that is safe."""
        if "<|" not in text:
            try:
                text.encode("latin-1")  # lower case is letter by letter there
                text = _FINAL_MARK.sub(r" \g<0>", text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def _learn(self, new: list[str]) -> None:
        cache = self.cache
        plain = [w for w in new if w.isalpha()]
        if plain:  # together: a word's last token carries the end mark
            got = self.lib.encode_batch_fast([" ".join(plain[i : i + 400]) for i in range(0, len(plain), 400)], add_special_tokens=False)
            ids = np.concatenate([np.asarray(e.ids, "<u4") for e in got])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(plain):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                cache.update(zip(plain, [raw[i:j] for i, j in zip([0, *ends], ends)]))
                new = [w for w in new if not w.isalpha()]
        for w, e in zip(new, self.lib.encode_batch(new, add_special_tokens=False), strict=True):
            cache[w] = np.asarray(e.ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: full windows, then the remainder."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    end = int(end_id).to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> list:
        tok = tokenizer(path)
        rows = []
        for doc_id, own in zip(batch["doc_id"].to_pylist(), tok.ids(batch["text"].to_pylist()), strict=True):
            ids = own + end
            n = len(ids) // 4
            for start in range(0, n, capacity):
                part = ids[4 * start : 4 * (start + capacity)]
                rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
        return list(map(list, zip(*rows, strict=True)))

    return map_rows(texts(docs), run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


class Windows:
    """Open windows by remaining room: a segment tree over 1..capacity marks the rooms in use."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """A window of the least room of at least ``need``."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.count[i] -= 1
            i //= 2
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length; ``lengths`` must not increase."""
    windows, used, where, offset = Windows(capacity), 0, [], []
    for n in lengths:
        got = windows.take(n)
        room, window = got or (capacity, used)
        used += got is None
        where.append(window)
        offset.append(capacity - room)
        if room > n:
            windows.add(room - n, window)
    return where, offset


OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece with its sequence and its offset in it."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.cut(cut(docs, path, capacity, end_id))
    shards = max(1, -(-pieces.count() // shard_pieces))

    def run(key: tuple, held: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        held = held.drop_columns(["shard"]).sort_by(order)
        where, offset = best_fit_decreasing(held["length"].to_pylist(), capacity)
        base = key[0].as_py() << 40
        return held.append_column("sequence_id", pa.array([base + w for w in where], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    # the row of the written table deals rows that repeat an id, or have none, to all shards
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(run, OUT)
