"""Fuzzy line de-duplication by MinHash, in DataFrame functions alone.

Lines are cut at newlines. Equal lines are one by digest. A line's set holds the
character shingles of SHINGLE characters that begin at every place, the last one included. Its
signature is a one-permutation MinHash: each shingle is hashed once, the distinct hashes are sorted
on a circle with BANDS marks at even distances, and a band is what the ROWS places after its mark
hold, round the end. Two lines share a band where no shingle of one alone lies among those places, which
for long lines has the chance of likeness**ROWS. Marks take up places too, so bands of short lines hold
fewer shingles; a band of less than LEAST shingles is left out, and a set of at most WHOLE shingles has one more
band, of the whole set. Candidates are verified by the exact Jaccard likeness of their shingles (64-bit
hashes), and distributed union-find keeps the first line (least doc_id, then position) of each component.

Defined results: a null text stays null and has no lines; lines of white space alone are always
kept; a line shorter than a shingle is compared by equality alone;
rows that repeat a doc_id share their decisions (a position that any of them keeps stays in all); a null doc_id
counts as the least id; texts of any length are handled line by line; an empty table gives an empty result;
further columns pass through ``dedup`` unchanged, except n_lines and n_kept, which it sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.near_links import differing, linked_components, small
from runlens.llm.scratch import Scratch

SHINGLE, THRESHOLD, BANDS, ROWS, LEAST, WHOLE = 5, 0.8, 16, 6, 2, 4
#: 64-bit words of a line's parity sketch.
SKETCH = 16
#: Hubs of a bucket in each round: most near lines link to the first one.
HUBS = (1, 4)
_ID = "__line_doc"


def hashes(line: Column, hashed=F.xxhash64) -> Column:
    """Hashes of the shingles at every place of a line, in order and with repeats; null for shorter lines.

    Shingles are cut from four bytes a character, at a fixed cost each; the one-element array
    holds those bytes for all of them.
    """
    size = 4 * SHINGLE
    each = lambda u: F.transform(F.sequence(F.lit(1), F.octet_length(u) - (size - 1), F.lit(4)), lambda i: hashed(F.substring(u, i, F.lit(size))))
    return F.when(F.length(line) >= SHINGLE, F.get(F.transform(F.array(F.encode(line, "UTF-32")), each), F.lit(0)))


def _doc(df: DataFrame) -> DataFrame:
    return df.withColumn(_ID, F.coalesce("doc_id", F.lit(-(1 << 63))))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc, pos (0-based) and text of every line that is not blank."""
    return _doc(docs).select(F.col(_ID).alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike(r"\S"))


def signatures(lines: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per line: its digest ``lid``, doc, pos, the size ``n`` of its set, and its band keys (null where left out)."""
    marks = [F.lit(-(1 << 31) + (b << 32) // bands) for b in range(bands)]
    own = ("lid", "doc", "pos")
    # 32-bit hashes do for the signature: a chance collision only makes a candidate.
    circle = lines.select(_digest(F.col("line")).alias("lid"), "doc", "pos", F.sort_array(F.array_union(hashes(F.col("line"), F.hash), F.array(*marks))).alias("s"))
    circle = circle.select(*own, F.size("s").alias("size"), F.concat("s", F.slice("s", 1, rows)).alias("c"))
    marked = circle.select(*own, "size", "c", *(F.array_position("c", m).cast("int").alias(f"a{b}") for b, m in enumerate(marks)))
    shingled = F.col("a0").isNotNull()

    def key(b: int) -> Column:
        k = b + rows - LEAST + 1  # this mark lies beyond the band if LEAST shingles are in it
        beyond = (F.col(f"a{k % bands}") + F.col("size") * (k // bands) > F.col(f"a{b}") + rows) if k - b <= bands else F.lit(True)
        return F.when(beyond, F.xxhash64(F.lit(b), F.slice("c", F.col(f"a{b}") + 1, F.lit(rows))))

    # A higher-order function keeps a projection out of whole-stage code, whose one method would be too large here for the
    # JIT compiler; outside, every expression gets a method of its own.
    n = F.aggregate(F.array("size"), F.lit(-bands), lambda acc, x: acc + F.coalesce(x, F.lit(bands)))
    whole = F.when(shingled & (n <= WHOLE), F.xxhash64(F.lit(-1), F.slice("c", F.lit(1), F.col("size"))))
    return marked.select(*own, n.alias("n"), F.array(*(key(b) for b in range(bands)), whole).alias("keys"))


def kept_lines(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, pos) of the line kept of every component."""
    positions = F.lit(1 << 32).cast("decimal(11,0)")
    place = F.col("doc").cast("decimal(20,0)") * positions + F.col("pos")  # orders lines by document, then position
    doc_of, pos_of = F.floor(F.col("at") / positions).cast("bigint").alias("doc"), F.pmod(F.col("at"), positions).cast("int").alias("pos")
    signed = scratch.cut(signatures(line_rows(docs), bands, rows))
    first = scratch.cut(signed.groupBy("lid").agg(F.min(place).alias("at"), F.min("n").alias("n")))
    each = lambda line: signed.select(line, F.explode("keys").alias("key")).filter("key is not null")
    shared = scratch.cut(each(F.xxhash64("lid").alias("l")).groupBy("key").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).filter("lo != hi").select("key"))
    held = scratch.cut(each(F.col("lid")).join(small(shared, shared.count(), 8), "key").distinct())
    scratch.drop(signed, shared)
    ids = scratch.cut(held.select("lid").distinct().withColumn("uid", F.monotonically_increasing_id()))
    asked = ids.count()
    named = first.join(small(ids, asked, 40), "lid")
    places = named.select("lid", "uid", doc_of, pos_of).groupBy("doc").agg(F.collect_list(F.struct("pos", "uid", "lid")).alias("places"))
    texts = _doc(docs).select(F.col(_ID).alias("doc"), F.split("text", "\n").alias("lines")).join(small(places, asked, 64), "doc")
    found = texts.select(F.explode(F.transform("places", lambda p: F.struct(p["uid"].alias("uid"), p["lid"].alias("lid"), F.get("lines", p["pos"]).alias("line")))).alias("p")).select("p.*")
    lines = scratch.cut(found.filter(_digest(F.col("line")) == F.col("lid")).select("uid", "line").dropDuplicates(["uid"]))
    buckets = scratch.cut(held.join(small(named.select("lid", "uid", "n"), asked, 48), "lid").select("key", "uid", "n"))
    scratch.drop(held)

    def may_link(x: str, y: str) -> Column:
        """Sizes within the threshold, with room for colliding 32-bit hashes."""
        low, high = F.least(F.col(f"{x}n"), F.col(f"{y}n")).cast("double"), F.greatest(F.col(f"{x}n"), F.col(f"{y}n")).cast("double")
        return low + 2 + high * high / (1 << 31) >= high * threshold

    def verify(pairs: DataFrame) -> DataFrame:
        """By the sets of the pair's lines: a line is a tenth of its set's bytes or less, so lines are what is moved."""
        x, y = (lines.select(F.col("uid").alias(k), F.col("line").alias(f"l{k}")) for k in "ab")
        both = pairs.join(x, "a").join(y, "b").select("a", "b", *(F.array_distinct(hashes(F.col(f"l{k}"))).alias(f"s{k}") for k in "ab"))
        # Written before the filter, which would else work each set out anew wherever it is named.
        both = scratch.cut(both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common")))
        return both.filter(F.col("common") >= threshold * (F.col("total") - F.col("common")) - 1e-9).select("a", "b")

    words = [f"w{i}" for i in range(SKETCH)]

    def sketches(uids: DataFrame) -> DataFrame:
        """Parity sketches of lines: bit h of a line is the parity of its shingles with that hash."""
        each = lines.join(small(uids, uids.count()), "uid").select("uid", F.explode(F.array_distinct(hashes(F.col("line")))).alias("h"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("h", F.lit(64)).cast("int"))
        word = F.pmod(F.shiftright("h", 8), F.lit(SKETCH))
        return each.groupBy("uid").agg(*(F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(w) for i, w in enumerate(words)))

    def may_still_link(x: str, y: str) -> Column:
        """The sketches' bound, on sizes that 32-bit hashes may have made smaller by their collisions."""
        slack = F.col(f"{x}n").cast("double") * F.col(f"{x}n") / (1 << 31) + F.col(f"{y}n").cast("double") * F.col(f"{y}n") / (1 << 31) + 4
        return may_link(x, y) & (differing(x, y, words) <= (F.col(f"{x}n") + F.col(f"{y}n") + slack) * ((1 - threshold) / (1 + threshold)))

    roots = linked_components(scratch, buckets, verify, may_link, HUBS, sketches, may_still_link)
    members = roots.unionAll(roots.select(F.col("root").alias("uid"), "root").distinct())
    members = scratch.cut(members.join(small(ids, asked, 40), "uid").select("lid", "root"))
    linked = small(members, members.count(), 40)
    alone = first.join(linked, "lid", "left_anti").select("at")
    led = first.join(linked, "lid").groupBy("root").agg(F.min("at").alias("at")).select("at")
    return alone.unionAll(led).select(doc_of, pos_of)


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents with the lines that are not kept taken out; n_lines and n_kept follow the columns.

    Blank lines count as kept.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    chosen = scratch.cut(kept_lines(docs, scratch, **options))
    scratch.only(chosen)
    kept = chosen.groupBy(F.col("doc").alias("__doc")).agg(F.array_sort(F.collect_list("pos")).alias("__kept"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    joined = _doc(docs).select(_ID, F.struct(*own).alias("__row")).join(kept, F.col(_ID) == F.col("__doc"), "left").withColumn("__lines", F.split("__row.text", "\n"))
    blank = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: ~F.get("__lines", i).rlike(r"\S"))
    places = F.array_sort(F.concat(F.coalesce("__kept", F.array().cast("array<int>")), blank))
    out = joined.select("__row", "__lines", places.alias("__places"))
    text = F.array_join(F.transform("__places", lambda i: F.get("__lines", i)), "\n")
    return out.select(
        *(F.when(F.col("__row.text").isNotNull(), text).alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in own),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__places"), F.lit(0)).cast("bigint").alias("n_kept"),
    )
