"""The pipeline's stages on nulls, empty and long texts, repeated rows, clashing columns and an empty table."""

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sig string, key string"


def test_stages_on_hard_rows(spark):
    line = " ".join(f"word{i}" for i in range(30))
    rows = [(1, line), (1, line), (2, None), (3, ""), (None, line + " more"), (None, None), (4, "x\n" * 2000 + "y " * 50_000), (5, " \n\t"), (6, "mail me at a.b@c.example now, please do"), (6, "another text of that id, quite different")]
    hard = spark.createDataFrame([(i, t, "en" if t else None, None, None, "s", "k") for i, t in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        for df in (hard, hard.limit(0)):
            out = stage(spark, df, "")
            found = out.collect()
            if name != "packing":
                assert tuple(out.columns) == corpus_pipeline.COLUMNS
            if name == "pii":
                assert len(found) in (0, len(rows)) and not any("@c.example" in (r.text or "") for r in found)
            if name == "shingle_join" and found:
                texts = [r.text for r in found]
                assert texts.count(line) == 1 and "another text of that id, quite different" in texts and texts.count(None) == 2
