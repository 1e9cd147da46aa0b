"""The line dedup against the shingles of every place, on its own truth."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.llm import line_dedup
from tests.llm.test_near_ops import brute_dedup, frame, line_set


def deduped(spark, texts, **options):
    return {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, texts), **options).collect()}


@pytest.mark.parametrize("a, b", [("Total amount: 100", "Total amount: 200"), ("Licensed under MIT", "Licensed under GPL"), ("Chapter 1: alpha", "Chapter 1: aorta")])
def test_lines_that_differ_at_the_end_stay(spark, a, b):
    assert deduped(spark, [a, b]) == {0: a, 1: b}


def test_shingles_of_every_place(spark):
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghé\U0001f600") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    base = [" -- ".join(rng.choice(words) for _ in range(rng.choice((3, 8, 15, 30)))) for _ in range(12)]

    def line():
        x = rng.choice(base)
        for _ in range(rng.choice((0, 1, 1, 2))):
            at = rng.randrange(len(x))
            x = x[:at] + rng.choice(words) + x[at + rng.randrange(4) :]
        return x

    texts = ["...........  ,,\n...........  ,;", *("\n".join(line() for _ in range(rng.randint(1, 6))) for _ in range(40))]
    # Many bands of few shingles leave no candidate out, so that verification alone decides.
    assert deduped(spark, texts, bands=48, rows=4) == brute_dedup(list(enumerate(texts)))


def test_one_changed_word_is_near(spark):
    line = "the quick brown fox jumps over the lazy dog while seven grey wolves watch quietly from a far hills"
    other = line.replace("grey", "pale")
    x, y = line_set(line), line_set(other)
    assert len(line) == 98 and len(x & y) >= 0.8 * len(x | y)
    assert deduped(spark, [line, other]) == {0: line, 1: ""}


@pytest.mark.parametrize("union, most", [(5, 0.02), (6, 0.005), (10, 0.003), (20, 0.003), (50, 0.004), (100, 0.008), (250, 0.012), (600, 0.016)])
def test_recall_at_the_threshold(spark, union, most):
    """Pairs of lines at a likeness of 0.8 (or the next above) that share no band, measured on the query's own signatures."""
    n, rng = 4000, random.Random(union)
    alphabet = [chr(c) for c in range(0x4E00, 0x9000)]
    rows = []
    for i in range(n):
        # x drops a tail of y's shingles and y a head of x's: shingles here never repeat, so a line's set is as large as it is long.
        apart = union // 5
        text = "".join(rng.choice(alphabet) for _ in range(union + line_dedup.SHINGLE - 1))
        cut = rng.randint(0, apart)
        rows += [(i, 0, text[cut:]), (i, 1, text[: len(text) - (apart - cut)])]
    signed = line_dedup.signatures(spark.createDataFrame(rows, "doc bigint, pos int, line string")).select("doc", "pos", F.filter("keys", lambda k: k.isNotNull()).alias("keys"))
    pairs = signed.filter("pos = 0").join(signed.filter("pos = 1").select("doc", F.col("keys").alias("other")), "doc")
    missed = pairs.filter(~F.arrays_overlap("keys", "other")).count() / n
    print(f"union of {union}: {missed:.4f} missed")
    assert pairs.count() == n and missed <= most
