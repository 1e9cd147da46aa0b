"""The pipeline's stages against brute force on their own inputs, and the chat query against its SQL."""

import re

import duckdb
import public_tokenizers as P

import corpus_pipeline
from runlens.llm import language_id, pii_spans, queries
from tests.llm.test_near_ops import brute_components, brute_dedup
from tests.llm.test_text_ops import brute_spans, check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, states = spark.read.parquet(f"{SF}/documents.parquet").limit(120), []
    for name, stage in corpus_pipeline.STAGES:
        states.append((docs, stage(spark, docs, SF)))
        states[-1][1].write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        states[-1] = (states[-1][0], docs)
    rows = [({r.doc_id: r for r in a.collect()}, b) for a, b in states]
    for a, b in rows[:-1]:
        assert tuple(b.columns) == corpus_pipeline.COLUMNS and b.filter("n_chars <> length(text)").count() == 0
    (a, b), got = rows[0], {r.doc_id for r in rows[0][1].collect()}
    model = language_id.fit(states[0][0])
    assert got == {i for i, r in a.items() if model.predict(r.text or "")[0] != "und" and model.predict(r.text)[1] >= 0.25}
    (a, b) = rows[1]
    want = {i: t for i, t in brute_dedup([(i, r.text) for i, r in a.items()]).items() if re.search(r"\S", t) or not re.search(r"\S", a[i].text or "")}
    assert {r.doc_id: r.text for r in b.collect()} == want
    (a, b) = rows[2]
    want = {i for i, (_, c) in brute_components([(i, r.text) for i, r in a.items()], 5, 0.8).items() if i == c}
    assert {r.doc_id: r.text for r in b.collect()} == {i: a[i].text for i in want}
    (a, b) = rows[3]
    assert {r.doc_id for r in b.collect()} == a.keys() and all(not brute_spans(r.text) for r in b.collect())
    (a, b) = rows[4]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    check_packing(b.collect(), {i: tok.encode(r.text, add_special_tokens=False).ids for i, r in a.items()})


def test_chat_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = queries.op9_chat_format(spark, SF)
    names = sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(con.sql(f"select {', '.join(names)} from ({queries.ORACLE_SQL['op9_chat_format']})").fetchall(), key=str)
    assert {r.valid for r in got.collect()} == {True, False} or got.filter('not valid').count() == 0
