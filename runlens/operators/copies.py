"""Pairs of documents with like sets of tokens, by prefixes instead of all pairs of a group.

Of any common order of tokens, two sets of likeness t or more share one in the first ``n - ceil(2 t n / (1 + t)) + 1`` of the
smaller and the first ``n - ceil(t n) + 1`` of the larger. Such pairs pass exact bounds by size, position and parity sketch inside the
join, and are verified on their whole sets, once each. Equal sets are one from the start. Sets are compared by 64-bit codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a set's parity sketch.
SKETCH = 4


def _codes(tokens: Column) -> Column:
    """Sorted codes of distinct tokens, long ones (mostly rare) first: 6 bits of length, 58 of a hash."""
    return F.array_sort(F.transform(tokens, lambda t: F.shiftleft((63 - F.least(F.length(t), F.lit(63))).cast("bigint"), 58).bitwiseOR(F.shiftrightunsigned(F.xxhash64(t), 6))))


def _word(codes: str, i: int) -> Column:
    """Parities of the codes on 64 places: sets differ in at least as many tokens as these words in bits."""
    return F.expr(f"aggregate({codes}, 0L, (s, x) -> s ^ if((x & {SKETCH - 1}) = {i}, shiftleft(1L, cast(shiftright(x, 6) & 63 as int)), 0L))")


def near_pairs(docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: ids of rows of the same ``part`` whose ``tokens`` are alike to ``threshold`` at least.

    ``docs``: id, part (any type), tokens (distinct). Null ids or parts and empty sets pair with nothing; rows that repeat an id each pair.
    """
    t = docs.filter("id is not null and part is not null").select("id", "part", _codes(F.col("tokens")).alias("w"))
    key = F.struct(F.xxhash64("part", "w").alias("h1"), F.xxhash64(F.lit(1), "w", "part").alias("h2"))
    sets = t.select("id", F.xxhash64("part").alias("g"), key.alias("u"), F.struct("w", *(_word("w", i).alias(f"s{i}") for i in range(SKETCH))).alias("s"))
    sets = sets.groupBy("u", "g").agg(F.first("s").alias("s"), F.collect_list("id").alias("ids")).select("u", "g", "s.*", "ids").filter("size(w) > 0 and size(ids) > 0")
    like, apart = 2 * threshold / (1 + threshold), (1 - threshold) / (1 + threshold)
    sized = sets.withColumn("n", F.size("w"))
    longest = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    post = sized.select("u", "n", *(f"s{i}" for i in range(SKETCH)), "g", F.posexplode(F.slice("w", F.lit(1), longest)).alias("i", "k"))
    post = post.select(F.xxhash64("g", "k").alias("k"), "u", "n", "i", *(f"s{i}" for i in range(SKETCH)))
    x, y = post.alias("x"), post.alias("y")
    smaller = "(x.n < y.n or (x.n = y.n and x.u < y.u))"
    short = f"x.i <= x.n - ceil(x.n * {like!r}D - 1e-9)"
    sizes = f"x.n >= y.n * {threshold!r}D - 1e-9"
    place = f"1 + least(x.n - 1 - x.i, y.n - 1 - y.i) >= (x.n + y.n) * {like / 2!r}D - 1e-9"
    bits = " + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in range(SKETCH))
    met = x.join(y, F.expr(f"x.k = y.k and {smaller} and {short} and {sizes} and {place} and {bits} <= (x.n + y.n) * {apart!r}D + 1e-9"))
    met = met.select(F.col("x.u").alias("u"), F.col("y.u").alias("v")).distinct()
    whole = sets.select("u", "g", "w", "ids")
    first = met.join(whole, "u").select("v", "g", F.col("w").alias("wu"), F.col("ids").alias("iu"))
    found = first.join(whole.withColumnsRenamed({"u": "v"}), ["v", "g"])
    common = F.size(F.array_intersect("wu", "w"))
    pairs = found.filter(common / (F.size("wu") + F.size("w") - common) >= threshold).select(F.explode("iu").alias("p"), "ids").select("p", F.explode("ids").alias("q"))
    pairs = pairs.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    of = sets.filter("size(ids) > 1").select("u", F.explode("ids").alias("p"))
    same = of.join(of.withColumnsRenamed({"p": "q"}), "u").filter("p < q").select(F.col("p").alias("a"), F.col("q").alias("b"))
    return pairs.unionByName(same)
