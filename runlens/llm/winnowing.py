"""Document fingerprints by winnowing, in DataFrame functions alone.

Every k-gram of code points is hashed; of each window of w consecutive hashes the least is chosen,
the rightmost of equal ones, and kept with its position. Any passage of w + k - 1 code
points that two texts share is then found: they share a window, so they choose the same gram in it.

A gram's hash and position are one long, ``hash << 31 | (2^31 - 1 - position)``: the least of a
window is the least hash with the rightmost position. Each gram is hashed on its own by the
JVM's xxHash (32 bits of it) rather than from its predecessor, as DataFrame functions offer no
running fold over an array at a linear cost; the hashes serve alike.

Long texts are handled in blocks that overlap by w + k - 2 code points, which chooses the same
grams as the whole text does, so that what a row holds at once is bounded by the block.

Defined results: a null or empty text has an empty fingerprint; a text shorter than k is one gram;
fewer grams than w form one window; equal texts have equal fingerprints; the likeness
of two empty fingerprints is 1, of an empty and another one 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 16, 16
BLOCK = 32_768
#: Rows of a range of doc_id in which neighbours are found, and ranges at most.
RANGE_ROWS, MAX_RANGES = 256, 65_536
_LAST = (1 << 31) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pack(gram: Column, at: Column) -> Column:
    return F.xxhash64(gram).bitwiseAND(F.lit(((1 << 32) - 1) << 31)).bitwiseOR(F.lit(_LAST).cast("bigint") - at)


def full_grams(text: Column, start: Column | None, k: int = K) -> Column:
    """The grams of k code points as packed longs; positions count from ``start`` (0 where None)."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1)), lambda g, i: _pack(g, i if start is None else start + i))


def packed_grams(text: Column, start: Column | None, k: int = K) -> Column:
    """``full_grams``, or the whole of a shorter text as one gram, none of an empty one."""
    short = F.when(F.length(text) > 0, F.array(_pack(text, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.length(text) < k, short).otherwise(full_grams(text, start, k))


def minima(p: Column, w: int, step: int, use: Callable[[Column], Column]) -> Column:
    """Hand ``use`` the least of every w values from each place on; windows cut by the end come last. w is a power of two."""
    if step == w:
        return use(p)
    return let(F.transform(p, lambda x, i: F.least(x, F.get(p, i + step))), lambda q: minima(q, w, 2 * step, use))


def choose(grams: Column, w: int = WINDOW) -> Column:
    """The distinct minima of all windows of w grams, in order."""
    cut = lambda q: F.array_distinct(F.slice(q, F.lit(1), F.greatest(F.lit(1), F.size(q) - w + 1)))
    return let(grams, lambda p: F.when(F.size(p) == 0, p).otherwise(minima(p, w, 1, cut)))


def fingerprint(text: Column, k: int = K, w: int = WINDOW, block: int = BLOCK) -> Column:
    """The winnowed grams of a text as packed longs."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - (w + k - 1), F.lit(0)), F.lit(block))
    part = lambda s: F.substr(text, s + 1, F.lit(block + w + k - 2))
    whole = choose(packed_grams(text, None, k), w)
    blocks = F.array_distinct(F.flatten(F.transform(starts, lambda s: let(part(s), lambda t: choose(packed_grams(t, s, k), w)))))
    return F.when(F.length(text) <= block, whole).otherwise(blocks)


def hashes(fp: Column) -> Column:
    """The distinct gram hashes of a fingerprint."""
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1)))


def as_text(fp: Column) -> Column:
    """Decimal numbers ``hash * 2^31 + position``, in order of position."""
    return F.array_join(F.transform(fp, lambda x: x.bitwiseXOR(F.lit(_LAST).cast("bigint"))).cast("array<string>"), ",")


def both_fingerprints(text: Column, edited: Column, kept: Column, k: int = K, w: int = WINDOW, block: int = BLOCK) -> Column:
    """struct(a, b): fingerprints of a text and of one that shares its first ``kept`` code points.

    Grams and windows inside the shared part are worked out once.
    """
    shared = F.greatest(kept - k + 1, F.lit(0))  # grams in common
    start = F.greatest(shared - w + 1, F.lit(0))  # windows in common
    distinct = F.array_distinct

    def pair(g: Column, m: Column) -> Column:
        tail = full_grams(F.substr(edited, shared + 1), shared, k)
        rest = lambda t: F.when((F.size(t) == 0) & (start > 0), t).otherwise(choose(F.concat(F.slice(g, start + 1, shared - start), t), w))
        joined = distinct(F.concat(F.slice(m, F.lit(1), start), let(tail, rest)))
        alone = choose(packed_grams(edited, None, k), w)
        own = F.when(F.size(g) == 0, g).otherwise(distinct(F.slice(m, F.lit(1), F.greatest(F.lit(1), F.size(m) - w + 1))))
        return F.struct(own.alias("a"), F.when(F.length(edited) < k, alone).otherwise(joined).alias("b"))

    once = let(packed_grams(text, None, k), lambda g: minima(g, w, 1, lambda m: pair(g, m)))
    apart = F.struct(fingerprint(text, k, w, block).alias("a"), fingerprint(edited, k, w, block).alias("b"))
    return F.when(F.greatest(F.length(text), F.length(edited)) <= block, once).otherwise(apart)


def in_ranges(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows dealt to ``range`` by quantiles of ``k``, the first of each range also a ``guest`` of the one that it follows.

    In the circular descending order of k, every row's next one is then in its own range: the
    greatest of a range follows the least of the range above it, the greatest of all the least of all. Only the
    bounds, MAX_RANGES numbers at most, pass through the driver; a range is found in two steps
    of the root of their number each.
    """
    rows = docs.count()
    n = max(1, min(MAX_RANGES, rows // range_rows))
    top, found = docs.agg(F.max("k"), F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 1_000_000)).first()
    cuts = sorted({c for c in (found or []) if c < top} if n > 1 else set())
    bounds = [*cuts, top if top is not None else 0]
    step = max(1, int(len(bounds) ** 0.5))
    longs = lambda xs: F.lit([int(x) for x in xs]).cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    fine, coarse = longs(bounds), longs(bounds[step - 1 : -1 : step])
    major = F.size(F.filter(coarse, lambda c: c < F.col("k"))) * step
    with_major = docs.withColumn("range", major)
    within = F.slice(fine, F.col("range") + 1, F.lit(step))
    number = F.col("range") + F.size(F.filter(within, lambda c: c < F.col("k")))
    numbered = with_major.withColumn("range", F.least(number, F.lit(len(bounds) - 1)))
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    follows = F.struct(F.pmod(F.col("range") + 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("guest"))
    placed = F.when(F.get(fine, F.col("range")) == F.col("k"), F.array(own, follows)).otherwise(F.array(own))
    return numbered.withColumn("at", F.explode(placed)).withColumn("range", F.col("at.range")).withColumn("guest", F.col("at.guest")).drop("at")


def compare_edited(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document's.

    The edited text has its last half replaced by the start of the next document in descending
    order of doc_id (null as the least id, repeated ids ordered by the hash of their text). One shuffle moves the texts.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), text.alias("text"))
    rows = in_ranges(base, range_rows).withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("range").orderBy("guest", F.desc("k"), "tie")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    kept = (n - half).cast("int")
    edited = F.concat(F.substring("text", 1, kept), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    pairs = rows.withColumn("next", F.lead("text").over(order)).select("range", "guest", "k", "tie", "doc_id", "text", kept.alias("kept"), edited.alias("edited"))
    made = pairs.select("range", "guest", "k", "tie", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), both_fingerprints(F.col("text"), F.col("edited"), F.col("kept")).alias("f"))
    sets = made.select("*", hashes(F.col("f.a")).alias("ha"), hashes(F.col("f.b")).alias("hb"))
    out = sets.withColumn("hn", F.lead("ha").over(order)).filter(~F.col("guest"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("f.a")).alias("fingerprint"),
        as_text(F.col("f.b")).alias("edited_fingerprint"),
        likeness(F.col("ha"), F.col("hb")).alias("near_edited"),
        likeness(F.col("ha"), F.col("hn")).alias("near_next"),
    )
