"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets of likeness t or
more share at least k of the first ``n - ceil(t n) + k`` tokens of any order common to all
documents. The order here puts tokens known as frequent last, then goes by hash. Tokens of
the prefixes that stay frequent are indexed in combinations of two (the prefix is extended by one
for that), rare ones alone; a shared prefix holds a rare token or two frequent ones, so
nothing is missed. A large set with frequent tokens in its prefix would have too many combinations of two: its prefix is extended to
the whole set, which is cut by hash into more groups than two linked sets have tokens of one alone. So a group
holds the same tokens in both, and each group's combination (some five to ten tokens) is indexed. Sets of different
sizes cut alike within classes of sizes; each takes part in its own class and the next. Where the two rules meet, sets do both.
Candidates pass exact bounds by size, position and parity sketch, and are verified on their whole sets.

Equal sets are one class from the start, and a bucket's rows are tested hub by hub (see
``near_links``), so a group of copies is never expanded into pairs.

Defined results: a null or empty text or one without words has an empty set and links with
nothing; fewer words than a shingle make one shingle of all; texts of any length are read
whole; rows that repeat a doc_id each count as a document; a row with a null doc_id (the least
64-bit number counts as null) takes part alike, and a component of such rows alone is null; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.near_links import linked_components, may_differ, shared_buckets, small
from runlens.llm.rows import map_rows, texts
from runlens.llm.scratch import Scratch

#: A prefix token in more documents than this is frequent.
FREQUENT = 64
#: Frequent tokens sent to the executors, at most (8 bytes each); the bar is raised until they fit.
#: The list only shapes the common order: any list gives the same links.
LISTED_TOKENS = 1_000_000
#: Longest prefix whose frequent tokens are combined.
COMBINED_PREFIX = 12

#: 64-bit words of a set's parity sketch.
SKETCH = 8
SKETCHES = [f"s{i}" for i in range(SKETCH)]
GROUPED = "uid bigint, n bigint, keys array<bigint>, bare boolean"
#: Stands for a null doc_id inside.
_NO_ID = -(1 << 63)

_LOWER = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _ODD, np.uint64)]))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, case of A-Z dropped."""
    b = np.frombuffer(text.translate(_LOWER), np.uint8)
    word = b != 32
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = _BYTE[b[word]] * _powers(int(sizes.max()))[inner]
    return _mixed(np.add.reduceat(values, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(words, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = _mixed((out + h[i : i + len(out)]) * _ODD + np.uint64(i + 1))
    return np.unique(out + np.uint64(size))


def prefix_size(n: int, threshold: float, k: int = 1) -> int:
    """Tokens of which two linked sets share k, from the smaller's and the larger's first ones alike."""
    return min(n, n - math.ceil(threshold * n - 1e-9) + k)


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The largest sizes of the class of size ``n`` and of the next; linked sets lie in one class or in two next to each other."""
    low = 4
    while low < n:
        low = math.ceil(low / threshold + 1e-9)
    return low, math.ceil(low / threshold + 1e-9)


def group_keys(tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, bool]:
    """Keys of the groups of a set, in both its classes; whether a class has so many empty groups that equal ones may all be empty."""
    keys, bare = [], False
    for bound in size_bounds(len(tokens), threshold):
        apart = math.floor(2 * bound * (1 - threshold) / (1 + threshold) + 1e-9)
        groups = apart + 1 + max(8, apart // 8)
        at = (tokens >> np.uint64(11)) % np.uint64(groups)
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order], prepend=np.uint64(groups)))
        sums = np.add.reduceat(_mixed(tokens[order] + _ODD), starts)
        keys.append(_mixed(sums + at[order][starts] * _ODD + np.uint64(bound)))
        bare |= groups - len(starts) >= groups - apart
    return np.concatenate(keys).view(np.int64), bare


def wide_sketch(tokens: np.ndarray) -> bytes:
    """Parity bits in number about half the set's size: a power of two, 512 at least."""
    bits = 1 << max(9, (len(tokens) // 2).bit_length())
    return np.packbits(np.bincount((tokens >> np.uint64(30) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the other's length (parities add up)."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = (int.from_bytes(x[:half], "big") ^ int.from_bytes(x[half:], "big")).to_bytes(half, "big")
    return (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count()


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Sorted tokens in the common order: those listed as frequent last."""
    if not len(frequent):
        return tokens
    at = np.searchsorted(frequent, tokens).clip(max=len(frequent) - 1)
    listed = frequent[at] == tokens
    return np.concatenate([tokens[~listed], tokens[listed]])


def sets(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """doc_id, n, the set's 128-bit digest, and its lowest tokens (those that prefixes may reach)."""

    def run(batch: pa.RecordBatch) -> list:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            s = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"", words)
            reach = min(len(s), prefix_size(len(s), threshold) * 6 // 5 + 4) if len(s) else 0
            rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[:reach].view(np.int64)))
        return list(map(list, zip(*rows, strict=True)))

    return map_rows(texts(docs), run, "doc_id bigint, n bigint, sig binary, low array<bigint>")


def prefixes(docs: DataFrame, words: int, threshold: float, frequent: np.ndarray) -> DataFrame:
    """doc_id, the digest, the extended prefix and the parity sketches of every set."""
    listed = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batch: pa.RecordBatch) -> list:
        rows, low = [], listed.value
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            s = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"", words)
            if len(s):
                parity = np.packbits(np.bincount((s >> np.uint64(20) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1).view(np.int64)
                rows.append((doc_id, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), ordered(s, low)[: prefix_size(len(s), threshold, 2)].view(np.int64), wide_sketch(s), *parity.tolist()))
        return list(map(list, zip(*rows, strict=True))) if rows else [[]] * (4 + SKETCH)

    return map_rows(texts(docs), run, "doc_id bigint, sig binary, prefix array<bigint>, wide binary, " + ", ".join(f"{c} bigint" for c in SKETCHES))


def listed_tokens(tokens: DataFrame, frequent: int, most: int) -> np.ndarray:
    """Sorted tokens of more than ``frequent`` rows; the bar doubles until at most ``most`` are left."""
    counted = tokens.groupBy("token").count().filter(F.col("count") > frequent)
    bars = counted.groupBy(F.floor(F.log2(F.col("count") / frequent)).cast("int").alias("bar")).count().collect()  # a row for each power of two
    bar, total = 0, sum(r["count"] for r in bars)
    while total > most:
        total -= sum(r["count"] for r in bars if r["bar"] == bar)
        bar += 1
    if not total:
        return np.zeros(0, np.uint64)
    found = counted.filter(F.floor(F.log2(F.col("count") / frequent)) >= bar).select("token").toArrow().column("token").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def index_rows(scratch: Scratch, rows: DataFrame, threshold: float, frequent: int, combined: int, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, uid, n, pos) of keys with several uids: rare tokens alone, frequent ones in pairs or, for large sets, in groups.

    ``rows``: (token, uid, n, pos) of the extended prefixes. ``grouped``: from uids to (uid, n, keys, bare) of ``group_keys``.
    Linked sets differ in size by the threshold at most: sets up to ``top`` index pairs, sets from ``threshold * top``
    on groups, so any two linked sets that share frequent tokens alone have one of the two ways in common.
    """
    counts = scratch.cut(rows.groupBy("token").count().filter("count > 1"))
    live = scratch.cut(rows.join(small(counts, counts.count()), "token"))
    top = combined
    while prefix_size(top + 1, threshold, 2) <= combined:
        top += 1
    common = F.col("count") > frequent
    large = common & (F.col("n") >= math.floor(threshold * top))
    alone = live.filter(~common).select(F.col("token").alias("key"), "uid", "n", "pos")
    held = live.filter(common & (F.col("n") <= top)).groupBy("uid", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    first = held.select("uid", "n", "t", F.posexplode("t").alias("i", "x"))
    pairs = first.select("uid", "n", F.col("x.pos").alias("pos"), F.col("x.token").alias("token"), F.explode(F.slice("t", F.col("i") + 2, F.greatest(F.size("t") - F.col("i") - 1, F.lit(0)))).alias("y"))
    pairs = pairs.select(F.xxhash64("token", "y.token", F.lit("pair")).alias("key"), "uid", "n", "pos")
    groups = scratch.cut(grouped(live.filter(large & (F.col("pos") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9))).select("uid").distinct()))
    bare = groups.filter("bare").select("uid")
    groups = groups.select(F.explode("keys").alias("key"), "uid", "n", F.lit(0).alias("pos"))
    bare = live.filter(large).join(bare, "uid", "left_semi").select(F.xxhash64("token", F.lit("bare")).alias("key"), "uid", "n", F.lit(0).alias("pos"))
    # A token's rows share it already; the other keys may have a row alone.
    return alone.unionAll(shared_buckets(scratch, pairs.unionAll(groups).unionAll(bare)))


def whole_sets(docs: DataFrame, places: DataFrame, uids: DataFrame, words: int, made: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """uid and what ``made`` gives for its set, worked out again from the texts of the rows asked for.

    ``places``: (uid, doc_id, sig).
    """

    def run(batch: pa.RecordBatch) -> list:
        uid, out = batch["uid"].to_pylist(), []
        for u, sig, text in zip(uid, batch["sig"].to_pylist(), batch["text"].to_pylist(), strict=True):
            s = shingle_set((text or "").encode("utf-8"), words)
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == sig:  # else another row of that doc_id
                out.append((u, *made(s)))
        return list(map(list, zip(*out, strict=True))) if out else [[]] * len(schema.split(","))

    asked = uids.count()
    wanted = docs.select("doc_id", "text").join(small(places.join(small(uids, asked), "uid"), asked, 48), "doc_id")
    return map_rows(wanted.select("uid", "sig", "text"), run, schema)


def verified(docs: DataFrame, places: DataFrame, wide: DataFrame, words: int, threshold: float, scratch: Scratch):
    """The check of pairs: by wide sketches first, then on whole sets, worked out for the rows still asked for.

    ``places``: (uid, doc_id, sig); ``wide``: (uid, n, wide). A wide sketch has half a bit for a token, a
    hundredth of the set's bytes, and bounds the likeness as the small ones do.
    """

    def plausible(batches):
        most = (1 - threshold) / (1 + threshold)
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("na", "nb", "wa", "wb"))
            keep = [differing_bits(x, y) <= (m + n) * most + 1e-9 for m, n, x, y in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(q, p).clip(max=len(q) - 1)
                common = int(np.count_nonzero(q[at] == p))
                keep.append(common >= threshold * (len(p) + len(q) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (wide.select(F.col("uid").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}")) for k in "ab")
        pairs = scratch.cut(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(plausible, "a bigint, b bigint"))
        uids = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct())
        whole = scratch.cut(whole_sets(docs, places, uids, words, lambda s: (s.tobytes(),), "uid bigint, tokens binary"))
        x, y = (whole.select(F.col("uid").alias(k), F.col("tokens").alias(f"s{k}")) for k in "ab")
        return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint").distinct()

    return verify


def join(docs: DataFrame, words: int = 5, threshold: float = 0.8, frequent: int = FREQUENT, listed: int = LISTED_TOKENS, combined: int = COMBINED_PREFIX) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), copies (rows of an equal set)."""
    if not 0.5 < threshold <= 1 or words < 1:
        raise ValueError("the threshold lies above 0.5 and up to 1, and a shingle has words")
    scratch = Scratch(docs.sparkSession, "shingles")
    docs = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text")
    known = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id"))
    meta = scratch.cut(sets(docs, words, threshold))
    classes = scratch.cut(
        meta.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("at"), F.min(known).alias("first"), F.min("n").alias("n"), F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id())
    )
    ids = classes.select("uid", F.col("at").alias("doc_id"), "sig")
    # One row of each class stands for it; its id may be repeated, so the digest is compared too.
    same = ["doc_id", "sig"]
    low = meta.filter("n > 0").select("doc_id", "sig", "low").join(ids, same, "left_semi").dropDuplicates(same)
    frequent_tokens = listed_tokens(low.select(F.explode("low").alias("token")), frequent, listed)
    slim = scratch.cut(meta.select("doc_id", "n", "sig"))
    scratch.drop(meta)
    del low
    held = prefixes(docs, words, threshold, frequent_tokens).join(classes.select("uid", F.col("at").alias("doc_id"), "sig", "n"), same)
    whole = scratch.cut(held.drop("sig", "doc_id").dropDuplicates(["uid"]))
    del held
    rows = whole.select("uid", "n", F.posexplode("prefix").alias("pos", "token"))
    grouped = lambda uids: whole_sets(docs, ids, uids, words, lambda s: (len(s), *group_keys(s, threshold)), GROUPED)
    buckets = index_rows(scratch, rows, threshold, frequent, combined, grouped)
    sketches = whole.select("uid", *SKETCHES)
    buckets = scratch.cut(buckets.join(small(sketches, whole.count(), 8 + 8 * SKETCH), "uid"))

    def may_link(x: str, y: str) -> F.Column:
        """Sizes within the threshold, and enough tokens left from the first shared one on.

        In one bucket of a linked pair the key's token is the first shared one, or the second: one
        frequent token may stand before a rare one.
        """
        nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
        need = F.ceil((nx + ny) * (threshold / (1 + threshold)) - 1e-9)
        return may_differ(x, y, SKETCHES, threshold) & (F.least(nx - F.col(f"{x}pos"), ny - F.col(f"{y}pos")) + 1 >= need)

    verify = verified(docs, ids, whole.select("uid", "n", "wide"), words, threshold, scratch)
    roots = scratch.cut(linked_components(scratch, buckets, verify, may_link))
    named = classes.join(small(roots, roots.count()), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.cut(named.join(least, "root").select("sig", "component_id", "copies"))
    scratch.only(slim, named)
    out = slim.join(named, "sig", "left")
    return out.select(
        known.alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, known).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n") == 0, F.lit(1)).otherwise(F.col("copies")).cast("bigint").alias("copies"),
    )
