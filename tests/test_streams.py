"""Streams over files give what their batch forms give."""

from pyspark.sql import functions as F

from runlens.operators import skills
from runlens.streaming import injection

HITS = "run_id bigint, pos bigint, filepath string"


def drain(df, tmp_path, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def feed(spark, tmp_path, batches, shape):
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_injection_fires_once_per_run(spark, tmp_path):
    batches = [[(1, 3, "a.py"), (1, 1, "b.py"), (2, 1, "a.py")], [(1, 4, "a.py"), (1, 5, "c.py"), (2, 2, "z.py")], [(2, 3, "b.py"), (1, 6, "b.py")]]
    items = spark.createDataFrame([("a.py::f", "s1"), ("a.py::g", "s2"), ("b.py", "s1"), ("c.py", "s3")], "api_path string, source_instance_id string")
    selected = spark.createDataFrame([("s1",), ("s2",)], "source_instance_id string")
    stream = feed(spark, tmp_path, batches, HITS)
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = sorted((r.run_id, r.pos, r.api_path) for r in skills.first_injections(batch, items, selected).collect())
    hits = injection.candidates(stream, items, selected)
    assert drain(injection.inject_once(hits).select("run_id", "pos", "api_path"), tmp_path, "once") == want
    assert [r[::2] for r in drain(injection.first_seen(hits).select("run_id", "pos", "api_path"), tmp_path, "seen")] == [r[::2] for r in want]


def test_an_ended_run_forgets(spark, tmp_path):
    stream = feed(spark, tmp_path, [[(1, 1, "a")], [(1, 2, None)], [(1, 3, "a"), (1, 4, "a")]], "run_id bigint, pos bigint, api_path string")
    assert drain(injection.inject_once(stream), tmp_path, "ended") == [(1, 1, "a"), (1, 3, "a")]


def test_status_counts(spark, tmp_path):
    stream = feed(spark, tmp_path, [[("a",), ("b",)], [("a",), (None,)]], "status string")
    assert set(drain(injection.status_counts(stream).select(F.coalesce("status", F.lit("-")).alias("status"), "n"), tmp_path, "counts", "complete")) == {("a", 2), ("b", 1), ("-", 1)}


def test_upserts_of_a_stream(spark, tmp_path):
    shape = "key string, at int, value string"
    stream = feed(spark, tmp_path, [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, None), ("b", 3, "w")], [("b", 2, "late"), ("c", 1, "z")]], shape)
    out = str(tmp_path / "out")
    query = stream.writeStream.foreachBatch(injection.upsert_sink(out, "key", "at")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/v2").collect()) == [("b", 3, "w"), ("c", 1, "z")]
