"""Operators 2, 3 and 10 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import line_dedup, shingle_join, winnowing
from runlens.llm.near_links import components
from runlens.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], SCHEMA)


# Components


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(1, 50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.uid: r.root for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 3: shingle join


def brute_components(rows, words, threshold):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9:
                common = len(x & y)
                if round(100 * common) >= round(100 * threshold) * (len(x) + len(y) - common):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts(seed, n=260):
    """Groups of near copies, copies, shared passages, short and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(12))
    out = [None, "", " \t\n", "one", "ONE", "one two", "a b c", "A b\x0bc d", "é É x", "  y z"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((8, 30, 60, 150, 600)))] for _ in range(12)]
    while len(out) < n:
        base = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        out.append((passage + " " if rng.random() < 0.4 else "") + " ".join(base))
    return out


@pytest.mark.parametrize("words,threshold,frequent,combined", [(3, 0.9, 3, 12), (5, 0.8, 2, 12), (3, 0.9, 1, 2), (2, 0.7, 1000, 12)])
def test_shingle_join_against_all_pairs(spark, words, threshold, frequent, combined):
    df = frame(spark, near_texts(words))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.join(df, words, threshold, frequent=frequent, combined=combined).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in df.collect()], words, threshold)


def test_op3_on_documents(spark):
    df = docs(spark).withColumn("sig", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.join(df, 3, 0.9, listed=1, frequent=2).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in df.collect()], 3, 0.9)
    assert shingle_join.join(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "x y z"), (None, "a b c d"), (None, "q r s")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in shingle_join.join(twice, 3, 0.9).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (2, 2), (None, 1), (None, None)], key=str)


def test_null_ids_are_linked(spark):
    words = [f"w{i}" for i in range(80)]
    near = [" ".join(words), " ".join([*words[:79], "x"]), " ".join([*words[:79], "y"])]
    rows = [(None, near[0]), (4, near[1]), (3, near[2]), (None, "q r s"), (None, "t u v")]
    got = [(r.doc_id, r.component_id) for r in shingle_join.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 0.9).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (4, 3), (3, 3), (None, None), (None, None)], key=str)


def test_groups_of_linked_sets_meet():
    """Sets at the threshold share the key of a group, whatever class their sizes lie in."""
    rng = np.random.default_rng(5)
    for threshold in (0.7, 0.8, 0.9):
        for n in (*range(5, 60), 100, 333, 1000, 4000):
            common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            spare = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            apart = int(n / threshold + 1e-9) - n
            for split in (0, apart // 2, apart):
                x, y = np.unique(np.concatenate([common, spare[:split]])), np.unique(np.concatenate([common, spare[n : n + apart - split]]))
                (p, bare_p), (q, bare_q) = shingle_join.group_keys(x, threshold), shingle_join.group_keys(y, threshold)
                assert np.intersect1d(p, q).size or (bare_p and bare_q)


# 2: winnowing


def brute_fingerprint(grams, w):
    """Positions chosen from a list of hashes: least of each window, rightmost of equal ones."""
    if not grams:
        return []
    chosen = []
    for i in range(max(1, len(grams) - w + 1)):
        part = list(enumerate(grams[i : i + w], i))
        at = max(p for p, h in part if h == min(h for _, h in part))
        if at not in chosen:
            chosen.append(at)
    return chosen


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_winnowing_against_brute_force(spark, block):
    rng = random.Random(9)
    texts = ["", "a", "abcdefg", "abcdefgh", "z" * 300, "\U0001f600é\n" * 40, "ab" * 200, *("".join(rng.choice("ab \n\U0001f600") for _ in range(rng.randint(1, 400))) for _ in range(60))]
    k, w = 8, 4
    df = frame(spark, texts)
    grams = df.select("doc_id", winnowing.packed_grams(F.col("text"), None, k).alias("g"), winnowing.fingerprint(F.col("text"), k, w, block).alias("f")).collect()
    for r in grams:
        assert [(1 << 31) - 1 - (x & (1 << 31) - 1) for x in r.g] == list(range(len(r.g)))
        assert len(r.g) == max(min(1, len(texts[r.doc_id])), len(texts[r.doc_id]) - k + 1)
        want = brute_fingerprint([x >> 31 for x in r.g], w)
        assert [(1 << 31) - 1 - (x & (1 << 31) - 1) for x in r.f] == want
    # The same through the shared work on an edited text.
    for kept in (0, 3, 10, 50):
        edited = F.concat(F.substring("text", 1, kept), F.reverse("text"))
        both = df.select(F.col("text").alias("t"), winnowing.both_fingerprints(F.col("text"), edited, F.least(F.lit(kept), F.length("text")), k, w, block).alias("f"), winnowing.fingerprint(edited, k, w).alias("e"), winnowing.fingerprint(F.col("text"), k, w).alias("a")).collect()
        assert all(r.f.a == r.a and r.f.b == r.e for r in both)


def test_match_guarantee(spark):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.WINDOW - 1))
    texts = ["".join(rng.choice("ijklmnop ") for _ in range(rng.randint(0, 90))) + passage + "".join(rng.choice("qrstuvwx ") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    sets = [set(r.h) for r in frame(spark, texts).select(winnowing.hashes(winnowing.fingerprint(F.col("text"))).alias("h")).collect()]
    assert all(a & b for a in sets for b in sets)


def check_op2(df, **options):
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0), reverse=True)
    got = {}
    for r in winnowing.compare_edited(df, **options).collect():
        got[r.doc_id] = r
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints = [{int(x) >> 31 for x in f.split(",") if x} for f in (g.fingerprint, g.edited_fingerprint, got[rows[(i + 1) % len(rows)].doc_id].fingerprint)]
        for other, near in ((prints[1], g.near_edited), (prints[2], g.near_next)):
            assert near == pytest.approx(len(prints[0] & other) / len(prints[0] | other) if prints[0] | other else 1.0)
        if text == edited:
            assert g.fingerprint == g.edited_fingerprint and g.near_edited == 1


def test_op2(spark):
    check_op2(docs(spark))
    check_op2(docs(spark), range_rows=7)
    hard = spark.createDataFrame([(5, None), (-3, ""), (10**17, "x" * 70_000), (8, "same text here, twice"), (9, "same text here, twice"), (None, "nobody's text"), (0, "\U0001f600" * 40), (1, "short")], "doc_id bigint, text string").withColumn("range", F.lit("clash"))
    check_op2(hard)
    check_op2(hard, range_rows=1)
    check_op2(hard.filter("doc_id = 8"))
    assert winnowing.compare_edited(hard.limit(0)).count() == 0


# 10: lines


def line_set(line):
    return {line[i : i + line_dedup.SHINGLE] for i in range(len(line) - line_dedup.SHINGLE + 1)}


def brute_dedup(rows):
    lines = [(i, p, x) for i, t in sorted(rows) for p, x in enumerate((t or "").split("\n")) if x.strip()]
    first, root = {}, {}
    for n, (_, _, x) in enumerate(lines):
        first.setdefault(x, n)
    texts = list(first)
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: line_set(x) for x in texts}
    for n, a in enumerate(texts):
        for b in texts[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((find(a), find(b)), key=first.get)
                root[q] = p
    kept = {lines[first[x]][:2] for x in texts if find(x) == x}
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if not x.strip() or (i, p) in kept) for i, t in rows}


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 11))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 4, 20, 40, 80)))) + "." for _ in range(20)]

    def line():
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice((0, 0, 1, 2))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words)

    texts = [None, "", "\n\n", "  \n\t", "!!!\n!!!", "ab\nab", *("\n".join(line() for _ in range(rng.randint(1, 7))) for _ in range(50))]
    df = frame(spark, texts).withColumn("doc", F.lit("clash")).withColumn("n_kept", F.lit("clash"))
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    want = brute_dedup(list(enumerate(texts)))
    assert {i: r.text or "" for i, r in got.items()} == want and got[0].text is None
    assert all(r.n_lines == (0 if texts[i] is None else texts[i].count("\n") + 1) for i, r in got.items())
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_line_dedup_on_documents(spark):
    df = docs(spark).limit(60)
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert got == brute_dedup([(r.doc_id, r.text) for r in df.collect()])
    twice = spark.createDataFrame([(1, "a line\nb"), (1, "a line\nb"), (None, "b\nc"), (2, "c\na line\n" + "w " * 50_000)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text[:20]) for r in line_dedup.dedup(twice).collect()), key=str)
    assert got == sorted([(1, "a line"), (1, "a line"), (None, "b\nc"), (2, "w w w w w w w w w w ")], key=str)
