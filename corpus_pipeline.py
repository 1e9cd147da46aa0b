"""A training corpus from ``documents``: five stages, each applied to all that the one before kept.

Every stage but the last returns the columns of ``documents``; each result is written as Parquet in the
shared folder and read again, so a lost executor costs the tasks of one stage at most.

Defined results, for every stage: an empty table gives an empty one; columns beyond those of ``documents`` are dropped, whatever their
names; texts of any length are read whole. Null and empty texts go in the first stage (they have no language); where a stage gets
them all the same, line dedup, near copies and personal data keep them and packing gives them their closing id. Rows that repeat a
doc_id or have a null one are rows of their own, but for line dedup, where those of one id share their decisions. Of equal
lines the first by (doc_id, position) stays, of equal documents the row with the least doc_id, of equal ids one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import language_id, line_dedup, pii_spans, shingle_join, token_packing
from runlens.llm.near_links import small
from runlens.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD_MODEL = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those without letters or of no learned language go."""
    return language_id.keep_identified(docs.select(*COLUMNS), language_id.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of every group of near lines; a document goes only if it had text and none is left."""
    out = line_dedup.dedup(docs.select(*COLUMNS, F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("__had")))
    kept = out.filter(~F.col("__had") | F.col("text").rlike(r"\S"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group linked by five-word shingles at 0.8 or more: that of the least doc_id, null being the greatest.

    Rows are told apart by doc_id where it is unique and never null, else by a number that each row gets.
    """
    scratch, docs = Scratch(spark, "copies"), docs.select(*COLUMNS)
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        found = shingle_join.join(docs, words=5, threshold=0.8)
        copies = scratch.cut(found.filter("doc_id != component_id").select("doc_id"))
        return docs.join(small(copies, copies.count()), "doc_id", "left_anti")
    docs = scratch.cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = scratch.cut(shingle_join.join(docs.select(F.col("__row").alias("doc_id"), "text"), words=5, threshold=0.8).select(F.col("doc_id").alias("__row"), "component_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = found.join(docs.select("__row", "doc_id"), "__row").groupBy("component_id").agg(F.min_by("__row", order).alias("__row")).select("__row")
    copies = scratch.cut(found.join(first, "__row", "left_anti").select("__row"))
    return docs.join(small(copies, copies.count()), "__row", "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii_spans.redact(docs.select(*COLUMNS))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, each with its sequence and offset."""
    return token_packing.pack(docs, public_tokenizers.path(WORD_MODEL))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("shingle_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_tokens),
]

#: SQL can't say the language filter, MinHash bands or tokenisation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
