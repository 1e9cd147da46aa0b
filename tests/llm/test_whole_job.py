"""Rows, records and languages that were once left out."""

import string

import corpus_pipeline
from runlens.llm import language_id, warc_zst


def test_near_copies_are_decided_by_row(spark):
    a, b, c, d = (" ".join(f"{p}{i}" for i in range(12)) for p in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, d), (None, d), (5, ""), (5, "")]
    df = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (None, d), (5, ""), (5, "")], key=str)


def test_dictionary_samples_reach_the_whole_archive():
    records = [bytes([65 + i % 26]) * 100_000 + f"<tail of {i}>".encode() * 5_000 for i in range(100)]
    samples = warc_zst.samples_of(records)
    assert sum(map(len, samples)) <= warc_zst.TRAIN_BYTES and len(samples) <= warc_zst.TRAIN_RECORDS
    met = {i for i in range(100) if any(f"<tail of {i}>".encode() in s for s in samples)}
    assert len(met) > 50 and {99, 98} & met
    assert all(any(s.startswith(r[:99]) for s in samples) for r in records)
    assert warc_zst.samples_of([]) == [] and warc_zst.samples_of([b"x" * 40_000]) == [b"x" * 32_768, b"x" * 7_232]


def test_more_languages_than_a_word_has_bits(spark):
    words = [x + y for x in string.ascii_lowercase for y in string.ascii_lowercase][:150]
    texts = {f"l{i:03}": f"{w}q{w}z{w} " * 6 for i, w in enumerate(words)}
    df = spark.createDataFrame([(k * 1000 + i, t, lang) for k in range(6) for i, (lang, t) in enumerate(texts.items())], "doc_id bigint, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == sorted(texts)
    assert [model.predict(t)[0] for t in texts.values()] == list(texts)
