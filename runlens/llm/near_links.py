"""Components of a similarity relation, found from buckets of candidates without listing all pairs.

Rows of a bucket are first tested against a few hubs, and the components of the links found so far
are taken. Only pairs of a bucket that still lie in different components can add anything. While those are
many for the rows they come from, and the round before found links, a further round tests strays against hubs of the bucket's
commonest component; in the end all pairs left are tested. A large group of copies thus costs some
tests per row, not per pair, and no link that would join two components is lost.

DataFrame functions alone; no group is gathered in one task and nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.scratch import Scratch

#: Bytes of a side that may be broadcast, at most: its counted rows by the width of one. In memory a hash table takes some four times that.
BROADCAST_BYTES = 16 << 20
#: Hubs of a bucket in the first round and in each further one.
HUBS = (4, 4)
#: Another round of hubs is worth its cost above so many pairs left for each row, and if the one before found a link
#: for so many rows left; and so many rounds are made at most. (Whatever they leave is tested pair by pair.)
PAIRS_A_ROW, ROWS_A_LINK, HUB_ROUNDS = 8, 100, 6


def small(df: DataFrame, rows: int, width: int = 16) -> DataFrame:
    """Hint a broadcast where the counted rows, of ``width`` bytes each, are within the bound; else the planner's own join."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def differing(x: str, y: str, sketch: list[str]) -> F.Column:
    """Bits in which two rows' sketches differ."""
    return sum((F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in sketch), F.lit(0))


def may_differ(x: str, y: str, sketch: list[str], threshold: float) -> F.Column:
    """Whether two sets can have the likeness, by sizes ``n`` and parity sketches: an exact bound.

    A sketch has a bit for each of many buckets of members: the parity of those of the set. Each bit that
    differs stands for a member of one set only, of which linked sets have (1-t)/(1+t) of their sizes' sum at most.
    """
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    return (F.least(nx, ny) >= F.greatest(nx, ny) * threshold - 1e-9) & (differing(x, y, sketch) <= (nx + ny) * ((1 - threshold) / (1 + threshold)) + 1e-9)


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(uid, root) of every row with a link; root is the least uid of its component.

    Distributed union-find by alternating large and small stars: every round replaces edges so
    that all rows of a component end at its least member, in a logarithmic number of rounds.
    """
    edges = scratch.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = state(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.cut(rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(new)
        scratch.drop(large, edges)
        edges = new
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("uid"), F.col("v").alias("root"))


def shared_buckets(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(key, uid, ...) restricted to keys of more than one uid."""
    keys = scratch.cut(rows.groupBy("key").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).filter("lo != hi").select("key"))
    out = scratch.cut(rows.join(small(keys, keys.count()), "key"))
    scratch.drop(keys)
    return out


def linked_components(
    scratch: Scratch,
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    may_link: Callable[[str, str], F.Column] | None = None,
    hubs: tuple[int, int] = HUBS,
    narrow: Callable[[DataFrame], DataFrame] | None = None,
    may_still_link: Callable[[str, str], F.Column] | None = None,
) -> DataFrame:
    """(uid, root) for rows linked to another one.

    ``buckets``: (key, uid, ...) where linked rows share a key, a table of ``scratch``, which is dropped. ``verify``: pairs (a, b), a < b, to
    those that link. ``may_link``: an exact bound on two bucket rows (column prefixes) that rules pairs out.
    ``narrow``: from the distinct uids still in buckets of several components after the first round to (uid, ...), further
    columns for ``may_still_link``, the bound from then on.
    """
    links = tested = roots = None
    labelled, turn, last = buckets.withColumn("root", F.col("uid")), 0, False
    while True:
        extra = [c for c in buckets.columns if c not in ("key", "uid")]
        side = lambda df, p, extra=extra: df.select("key", *(F.col(c).alias(f"{p}{c}") for c in ["uid", *extra, "root"]))
        if last:
            left = side(labelled, "x_")
        else:
            pool = labelled
            if turn:
                pool = pool.join(pool.groupBy("key").agg(F.mode("root", True).alias("root")), ["key", "root"])
            order = F.xxhash64("uid", F.lit(turn))
            best = pool.groupBy("key", F.pmod(order, F.lit(hubs[turn > 0])).alias("slot")).agg(F.min(F.struct(order.alias("h"), "uid", *extra, "root")).alias("s"))
            left = side(best.select("key", "s.*"), "x_")
        pairs = left.join(side(labelled, "y_"), "key").filter("x_root != y_root and x_uid != y_uid" + (" and x_uid < y_uid" if last else ""))
        if may_link is not None:
            pairs = pairs.filter(may_link("x_", "y_"))
        pairs = pairs.select(F.least("x_uid", "y_uid").alias("a"), F.greatest("x_uid", "y_uid").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, new = scratch.cut(pairs), 0
        if pairs.count():
            tested = pairs if tested is None else tested.unionAll(pairs)
            found = scratch.cut(verify(pairs))
            new = found.count()
            links = found if links is None else links.unionAll(found)
            roots = components(scratch, links) if new or roots is None else roots
        if last:
            return buckets.select("uid", F.col("uid").alias("root")).limit(0) if links is None else roots
        spent = [buckets]
        if links is not None:
            labelled = scratch.cut(buckets.join(small(roots, roots.count()), "uid", "left").withColumn("root", F.coalesce("root", "uid")))
            spent.append(labelled)
        counts = labelled.groupBy("key", "root").agg(F.count("*").cast("double").alias("m"))
        mixed = scratch.cut(counts.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q"), F.count("*").alias("roots")).filter("roots > 1"))
        keys, rows, left_pairs = mixed.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0.0)), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2), F.lit(0.0))).first()
        labelled = labelled.join(small(mixed.select("key"), keys), "key", "left_semi")
        if narrow is not None and not turn:
            more = scratch.cut(narrow(labelled.select("uid").distinct()))
            labelled = labelled.join(small(more, more.count(), 8 * len(more.columns)), "uid")
            may_link = may_still_link
        labelled = scratch.cut(labelled)
        scratch.drop(mixed, *spent)
        buckets = labelled.drop("root")  # the other buckets can join nothing any more
        buckets._runlens_path = labelled._runlens_path
        turn += 1
        last = new * ROWS_A_LINK < rows or turn == HUB_ROUNDS or left_pairs <= PAIRS_A_ROW * rows
