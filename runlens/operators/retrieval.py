"""BM25 retrieval as joins on an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import retrieval_tokens

K1, B = 1.5, 0.75
#: Rows of queries' tokens that are sent to every task, at most (some 16 MB); beyond, the planner chooses.
SENT = 100_000


def _weight(tf: Column, df: Column, length: Column, n: Column, average: Column, k1: float, b: float) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def _sender(wanted: DataFrame):
    """Marks tables of at most the rows of ``wanted`` for a broadcast where these are few: counted, since estimates by file size mistake the sides."""
    return F.broadcast if wanted.limit(SENT + 1).count() <= SENT else lambda df: df


def scores(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a token with the query; ``docs``: doc_id, text; ``queries``: query_id, text.

    Postings are made only for tokens of some query (semi join before the counts), so the index
    holds what the queries touch; N and the mean length still count every document. Documents are dealt by id
    once, so that counts and sums by document need no further shuffle; frequencies meet the few rows of queries, not the postings.
    """
    corpus = docs.select(retrieval_tokens(F.col("text")).alias("t")).agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("average"))
    wanted = queries.select("query_id", F.explode(retrieval_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qn"))
    sent = _sender(wanted)
    sized = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", retrieval_tokens(F.col("text")).alias("t"))
    postings = (
        sized.select("doc_id", F.size("t").alias("length"), F.explode("t").alias("token"))
        .join(sent(wanted.select("token").distinct()), "token", "left_semi")
        .groupBy("doc_id", "length", "token")
        .agg(F.count("*").alias("tf"))
    )
    seen = postings.groupBy("token").agg(F.count("*").alias("df"))
    asked = wanted.join(seen, "token").crossJoin(F.broadcast(corpus))  # one row of statistics
    w = _weight(F.col("tf"), F.col("df"), F.col("length"), F.col("n"), F.col("average"), k1, b)
    return postings.join(sent(asked), "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("qn") * w).alias("score"))


def top_k(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The k best documents of every query, ties by doc_id; documents without a shared token fill up with score 0.

    Only the k first documents by id that a query did not hit can be needed to fill up. The scores are made once:
    a query's best documents are one array, which the fill is added to.
    """
    found = scores(docs, queries, k1, b)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")  # sums of equal terms may differ in their last bits
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    best = best.groupBy(F.col("query_id").alias("_id")).agg(F.collect_list(F.struct("doc_id", "score")).alias("best"))
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.lit(0.0).alias("score")))).alias("first"))  # at most k of them were hit
    every = queries.select("query_id").distinct()
    listed = every.join(best, F.col("query_id").eqNullSafe(F.col("_id")), "left").crossJoin(F.broadcast(first))
    missed = F.filter("first", lambda x: ~F.exists("best", lambda y: y["doc_id"].eqNullSafe(x["doc_id"])))
    rows = listed.withColumn("best", F.coalesce("best", F.slice("first", 1, 0))).select("query_id", F.inline(F.when(F.size("best") < k, F.concat("best", missed)).otherwise(F.col("best"))))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def scores_as_of(items: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 where a query's corpus is the items of its repository with num <= the query's num.

    ``items``: doc_id, repo, num, text; ``queries``: query_id, repo, num, text. Corpus statistics are running
    totals over the distinct numbers; each query takes the last totals at or before its own number.
    Postings are made only for tokens that a query asks of the repository, and documents are dealt by id once; all
    statistics meet the few rows of queries, not the postings.
    """
    t = items.select("repo", "num", retrieval_tokens(F.col("text")).alias("t"))
    q = queries.select("query_id", "repo", F.col("num").alias("now"), F.explode(retrieval_tokens(F.col("text"))).alias("token")).groupBy("query_id", "repo", "now", "token").agg(F.count("*").alias("qn"))
    whole = t.groupBy("repo", "num").agg(F.count("*").alias("n"), F.sum(F.size("t")).alias("words"))
    now = queries.select("query_id", "repo", F.col("num").alias("now"))
    corpus = now.join(whole, "repo").filter("num <= now").groupBy("query_id").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("average"))
    sent = _sender(q)
    dealt = items.select("doc_id", "repo", "num", "text").repartition("doc_id").select("doc_id", "repo", "num", retrieval_tokens(F.col("text")).alias("t"))
    postings = (
        dealt.select("doc_id", "repo", "num", F.size("t").alias("length"), F.explode("t").alias("token"))
        .join(sent(q.groupBy("repo", "token").agg(F.max("now").alias("last"))), ["repo", "token"])
        .filter("num <= last")
        .groupBy("doc_id", "repo", "num", "length", "token")
        .agg(F.count("*").alias("tf"))
    )
    seen = postings.join(sent(q.select("query_id", "repo", "now", "token")), ["repo", "token"]).filter("num <= now").groupBy("query_id", "token").agg(F.count("*").alias("df"))
    asked = q.join(seen, ["query_id", "token"]).join(corpus, "query_id")
    w = _weight(F.col("tf"), F.col("df"), F.col("length"), F.col("n"), F.col("average"), k1, b)
    hits = postings.join(sent(asked), ["repo", "token"]).filter("num <= now")
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("qn") * w).alias("score"))
