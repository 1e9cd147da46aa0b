"""Work that must grow with the input and the result alone, told by the rows that the nodes of a plan put out."""

import random
import re

from pyspark.sql import functions as F

from runlens.operators import copies, retrieval, scopes, skills
from runlens.plans import queries


def ran(df):
    """The rows of a query and the most rows that any of its nodes put out."""

    def nodes(p):
        yield p
        inner = [p.executedPlan()] if hasattr(p, "executedPlan") and p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else []
        kids = p.children()
        for k in [*inner, *(kids.apply(i) for i in range(kids.size()))]:
            yield from nodes(k)

    rows = df.collect()
    most = 0
    for p in nodes(df._jdf.queryExecution().executedPlan()):
        m = p.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
    return rows, most


def test_align_grows_with_its_result(spark):
    ranges = spark.range(400).select(F.col("id").alias("range_id"), F.lit("a").alias("filepath"), F.lit(5).alias("start_line"), F.lit(9).alias("end_line"))
    parts = spark.range(400).select(F.lit("a").alias("filepath"), F.lit("C").alias("class_name"), F.concat(F.lit("f"), F.col("id") % 2).alias("function_name"), F.lit(1).alias("start_line"), F.lit(7).alias("end_line"))
    rows, most = ran(scopes.align(ranges, parts))
    assert sorted((r.range_id, r.scope_key) for r in rows) == [(i, f"a::C::f{k}") for i in range(400) for k in (0, 1)]
    assert most <= 800


def test_align_of_shared_and_missing_ids(spark):
    ranges = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 1, 2), (1, "b", None, None), (2, "a", 1, 2), (2, "a", 1, 2), (None, "a", 1, 2), (3, None, 1, 2), (4, "b", 40, 70)], "range_id int, filepath string, start_line int, end_line int")
    parts = spark.createDataFrame([("a", "C", None, 1, 9), ("b", "C", "f", 2, 3), ("b", None, "g", 1, 99), ("b", None, "g", 1, 99)], "filepath string, class_name string, function_name string, start_line int, end_line int")
    got = sorted((r.range_id or 0, r.scope_key) for r in scopes.align(ranges, parts).collect())
    one = [(1, f"{p}::{k}") for p in "abb" for k in ("C::f", "g")]
    assert got == sorted([*one, (2, "a::C"), (2, "a::C"), (0, "a"), (3, ""), (4, "b::g")])


def brute_pairs(rows, threshold):
    alike = lambda a, b: a and b and len(a & b) / len(a | b) >= threshold
    full = [(i, p, set(t)) for i, p, t in rows if i is not None and p is not None]
    return sorted((a, b) for a, p, x in full for b, q, y in full if a < b and p == q and alike(x, y))


def test_near_pairs_against_all_pairs(spark):
    dealt = random.Random(5)
    rows = []
    for i in range(240):
        if rows and dealt.random() < 0.6:
            tokens = [t for t in dealt.choice(rows)[2] if dealt.random() < 0.95] + [f"n{i}"] * (dealt.random() < 0.5)
        else:
            tokens = [f"{'x' * dealt.randrange(1, 6)}{dealt.randrange(60)}" for _ in range(dealt.choice([0, 1, 2, 4, 30, 80]))]
        rows.append((dealt.choice([i, i, i, i // 2, None]) if i % 9 == 0 else i, dealt.choice(["p", "q", "q", None]) if i % 7 == 0 else "p", sorted(set(tokens))))
    df = spark.createDataFrame(rows, "id bigint, part string, tokens array<string>")
    for threshold in (0.75, 0.8, 1.0):
        got = sorted((r.a, r.b) for r in copies.near_pairs(df, threshold).collect())
        assert got == brute_pairs(rows, threshold) and got


def test_copy_check_does_not_meet_all_pairs(spark, tmp_path):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), F.col("id") * 10 + i)), F.lit("the of and"))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"), F.lit(60).alias("n_chars"))
    docs.union(docs.filter("doc_id = 7").withColumn("doc_id", F.lit(1000))).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.copy_check(spark, str(tmp_path))
    rows, most = ran(df)
    assert [tuple(r) for r in rows] == [(7, 1000)] and most < 10_000
    assert not re.search(r"Join \[source#", df._jdf.queryExecution().executedPlan().toString())  # nor a join by bucket alone, whose rows are told only after its condition


def test_admitted_deals_a_repository_over_tasks(spark):
    items = spark.range(300).select(F.col("id").alias("item"), F.concat(F.lit("r-"), F.col("id").cast("string")).alias("source_instance_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("r-"), F.floor(F.col("id") / 2).cast("string"))).alias("original_instance_id"))
    now = spark.range(600).select(F.when(F.col("id") != 9, F.concat(F.lit("r-"), (F.col("id") % 590).cast("string"))).alias("current_id"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = skills.admitted(items, now).select("item", "now", "current_id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    num = lambda i: i // 2 if i % 2 == 0 else i
    assert sorted((r.item, r.now) for r in got) == sorted((i, k % 590) for i in range(300) for k in range(600) if k != 9 and num(i) <= k % 590)
    assert all(r.current_id == f"r-{r.now}" for r in got) and len({r.task for r in got}) > 8


def test_bm25_holds_only_what_queries_ask(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("r").alias("repo"), F.col("id").alias("num"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), F.col("id") * 100 + i))).alias("text"))
    asked = spark.createDataFrame([("a", "r", 40, "w700 w4100"), ("b", "r", 5, "none")], "query_id string, repo string, num bigint, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        as_of = retrieval.scores_as_of(docs, asked)
        assert [(r.query_id, r.doc_id) for r in as_of.collect()] == [("a", 7)]
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (as_of, retrieval.scores(docs, asked))]
        got = sorted((r.query_id, r.rank, r.doc_id) for r in retrieval.top_k(docs, asked, 3).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert not re.search(r"SortMergeJoin \[repo#\w+, token", plans[0]) and plans[1].count("SortMergeJoin [token") <= 1  # postings meet sent rows
    assert got == [("a", 1, 7), ("a", 2, 41), ("a", 3, 0), ("b", 1, 0), ("b", 2, 1), ("b", 3, 2)]
