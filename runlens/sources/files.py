"""Readers and writers of the record formats: trajectories, golden records, skills, JSONL, id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NAME, _DIR = r"([^/]+)$", r"([^/]+)/[^/]+$"


def whole_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, dir, name, content of files below ``root``."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return df.select(path.alias("path"), F.regexp_extract(path, _DIR, 1).alias("dir"), F.regexp_extract(path, _NAME, 1).alias("name"), F.col("value").alias("content"))


def trajectory_files(spark: SparkSession, root: str) -> DataFrame:
    """One file per directory by name: <dir>_trajectory.json, *.traj.json, *_trajectory.json; ties by path."""
    files = whole_files(spark, root, "*.json")
    rank = F.when(F.col("name") == F.concat("dir", F.lit("_trajectory.json")), 1).when(F.col("name").endswith(".traj.json"), 2).when(F.col("name").endswith("_trajectory.json"), 3)
    w = Window.partitionBy("dir").orderBy("rank", "path")
    return files.withColumn("rank", rank).filter("rank is not null").withColumn("i", F.row_number().over(w)).filter("i = 1").select(F.col("dir").alias("run_dir"), "path", "content")


def trajectory_messages(files: DataFrame) -> DataFrame:
    """run_dir, instance_id, pos, role, content of trajectory documents; content parts are joined by newlines.

    A document is an object with ``messages`` or a bare list of messages.
    """
    v = F.try_parse_json("content")
    doc = files.withColumn("v", v).filter("v is not null")
    listed = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", "$.messages", "array<variant>"))
    ident = F.coalesce(F.try_variant_get("v", "$.info.instance_id", "string"), F.try_variant_get("v", "$.info.task_id", "string"), F.col("run_dir"))
    rows = doc.select("run_dir", ident.alias("instance_id"), F.posexplode(listed).alias("pos", "m"))
    parts = F.array_join(F.transform(F.try_variant_get("m", "$.content", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "\n")
    body = F.when(F.schema_of_variant(F.variant_get("m", "$.content", "variant")).startswith("ARRAY"), parts).otherwise(F.try_variant_get("m", "$.content", "string"))
    return rows.select("run_dir", "instance_id", "pos", F.try_variant_get("m", "$.role", "string").alias("role"), body.alias("content"))


def jsonl(spark: SparkSession, path: str, lenient: bool = True) -> DataFrame:
    """path, line_no and the parsed value of every line that is not blank; bad lines are dropped or raise."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    rows = files.filter(F.trim("line") != "")
    if lenient:
        return rows.select("path", "line_no", F.try_parse_json("line").alias("v")).filter("v is not null")
    return rows.select("path", "line_no", F.parse_json("line").alias("v"))


def golden(spark: SparkSession, path: str, first_wins: bool = False) -> DataFrame:
    """instance_id and record from JSONL (by the file's name), a list, an object of objects, or one object; of repeated ids the last (or first) stands."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_name").contains("jsonl").alias("by_line"))
    files = files.withColumn("v", F.when(~F.col("by_line"), F.try_parse_json("content")))
    kind = F.schema_of_variant("v")
    lists = files.filter(kind.startswith("ARRAY")).select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("ord", "r"))
    one = files.filter(kind.startswith("OBJECT") & F.try_variant_get("v", "$.instance_id", "string").isNotNull()).select(F.lit(0).alias("ord"), F.col("v").alias("r"))
    maps = files.filter(kind.startswith("OBJECT") & F.try_variant_get("v", "$.instance_id", "string").isNull()).select(F.posexplode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("ord", "e"))
    maps = maps.select("ord", "e.key", "e.value").filter(F.schema_of_variant("value").startswith("OBJECT"))  # the key is the id, whatever the record says
    lines = files.filter("by_line").select(F.posexplode(F.split("content", "\r?\n")).alias("ord", "line")).select("ord", F.try_parse_json("line").alias("r")).filter("r is not null")
    rows = lists.unionAll(one).unionAll(lines).select("ord", F.try_variant_get("r", "$.instance_id", "string").alias("instance_id"), F.to_json("r").alias("record"))
    rows = rows.unionAll(maps.select("ord", "key", F.to_json("value"))).filter("instance_id is not null")
    pick = F.min_by if first_wins else F.max_by
    return rows.groupBy("instance_id").agg(pick("record", "ord").alias("record"))


def eval_status(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, resolved from a report; an id in both lists counts as resolved."""
    r = spark.read.text(path, wholetext=True).select(F.from_json("value", "resolved_ids array<string>, unresolved_ids array<string>, empty_patch_ids array<string>").alias("r"))
    none = F.array().cast("array<string>")
    ids = lambda *names: F.explode(F.concat(*(F.coalesce(F.col(f"r.{n}"), none) for n in names)))
    yes = r.select(ids("resolved_ids").alias("instance_id"), F.lit(True).alias("resolved"))
    no = r.select(ids("unresolved_ids", "empty_patch_ids").alias("instance_id"), F.lit(False).alias("resolved"))
    return yes.unionAll(no).groupBy("instance_id").agg(F.bool_or("resolved").alias("resolved"))


REQUIRED = ("instance_id", "base_commit", "problem_statement", "buggy_patch", "target_tests")


def bug_instances(spark: SparkSession, root: str) -> DataFrame:
    """Records of <root>/<original>/<test>/instances.jsonl that hold every required key, null or not."""
    v = jsonl(spark, f"{root}/*/*/instances.jsonl")
    at = r"([^/]+)/([^/]+)/instances\.jsonl$"
    rows = v.select(F.regexp_extract("path", at, 1).alias("original_instance_id"), F.regexp_extract("path", at, 2).alias("test"), "line_no", "v")
    for key in REQUIRED:
        rows = rows.filter(F.variant_get("v", f"$.{key}", "variant").isNotNull())
    return rows.select("original_instance_id", "test", "line_no", F.try_variant_get("v", "$.instance_id", "string").alias("instance_id"), F.to_json("v").alias("record"), F.from_json(F.try_variant_get("v", "$.target_tests", "string"), "array<string>").alias("target_tests"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.col("value")).alias("instance_id")).filter("instance_id <> ''")


def target_tests(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, pos, test from a map of id to tests."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("instance_id", "tests"))
    return m.select("instance_id", F.posexplode("tests").alias("pos", "test"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_repo_skills(df: DataFrame, path: str) -> None:
    """One ordered file of repository records; they are few by nature."""
    df.orderBy("repo_id").coalesce(1).write.mode("overwrite").json(path)


def write_predictions(spark: SparkSession, base_path: str, changes: DataFrame, out_path: str) -> None:
    """The predictions table after its changes, written beside the old one."""
    from runlens.operators.runs import upsert

    upsert(spark.read.parquet(base_path), changes, "instance_id", "seq").write.mode("overwrite").parquet(out_path)


def call_log_markdown(calls: DataFrame) -> DataFrame:
    """One Markdown section per recorded call, ordered by instance and kind."""
    body = F.concat(F.lit("## "), "instance_id", F.lit(" ("), "kind", F.lit(")\n\n- model: "), F.coalesce("model", F.lit("")), F.lit("\n\n"), F.coalesce("output", F.lit("")), F.lit("\n"))
    return calls.orderBy("instance_id", "kind").select(body.alias("value"))


def folder_names(spark: SparkSession, root: str) -> DataFrame:
    """instance_id of every sub-directory, empty ones too; one listing of the folder's entries."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return spark.createDataFrame([(e.getPath().getName(),) for e in entries if e.isDirectory()], "instance_id string")


def trajectory_documents(runs: DataFrame, form: str = "trajectory-1") -> DataFrame:
    """(instance_id, value): one JSON document a run, of (instance_id, exit_status, submission, instance_cost, api_calls, messages), with ``extra``
    (a struct) merged into its info where the column is there; of equal names the extra one stands."""
    stats = F.struct(F.coalesce("instance_cost", F.lit(0.0)).alias("instance_cost"), F.coalesce("api_calls", F.lit(0)).alias("api_calls"))
    info = {"exit_status": F.col("exit_status"), "submission": F.col("submission"), "model_stats": stats}
    if "extra" in runs.columns:
        info |= {name: F.col(f"extra.{name}") for name in runs.schema["extra"].dataType.names}
    doc = F.struct(F.struct(*(c.alias(name) for name, c in info.items())).alias("info"), "messages", F.lit(form).alias("trajectory_format"), "instance_id")
    return runs.select("instance_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


def save_trajectories(runs: DataFrame, path: str, form: str = "trajectory-1") -> None:
    """A folder per instance; saving again replaces only the folders of the given runs, so a run in progress can be saved after each step."""
    trajectory_documents(runs, form).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instance_id").text(path)


def status_yaml(rows: DataFrame, status: str, key: str, arrival: str) -> DataFrame:
    """Lines of a YAML report of the ids by status, in order; every string is quoted, so any id is valid."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(F.col(c).cast("string"))), r"^\[|\]\z", "")
    heads = rows.select(F.col(status).alias("s"), F.lit(None).cast("string").alias("k"), F.lit(None).cast(rows.schema[arrival].dataType).alias("a"), F.concat(F.lit("    "), quoted(status), F.lit(":")).alias("value")).distinct()
    ids = rows.select(F.col(status).alias("s"), F.col(key).cast("string").alias("k"), F.col(arrival).alias("a"), F.concat(F.lit("    - "), quoted(key)).alias("value"))
    top = rows.limit(1).select(F.lit(0).alias("o"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("k"), F.lit(None).cast(rows.schema[arrival].dataType).alias("a"), F.lit("instances_by_exit_status:").alias("value"))
    body = heads.withColumn("o", F.lit(1)).unionByName(ids.withColumn("o", F.lit(1)))
    return top.unionByName(body).orderBy("o", "s", F.col("k").isNotNull(), "a", "k").select("value")


#: Artefacts of a synthesis run, by their place in it.
PHASES = ("trace", "segments", "rankings", "attempts", "issue", "instance")


def write_phase(df: DataFrame, root: str, phase: str) -> None:
    """A phase's rows, with their ``run_id``, as JSON in <root>/<number>_<phase>/run_id=..; only the given runs are replaced."""
    number = PHASES.index(phase) + 1
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{root}/{number:02}_{phase}")


def metadata_files(instances: DataFrame) -> DataFrame:
    """(instance_id, name, value) of (instance_id, record, test_patch, patch): the record, and each patch that isn't null.

    A patch that is a JSON list is kept as one, any other text as it is.
    """
    patch = lambda c: F.when(F.col(c).startswith("["), F.coalesce(F.to_json(F.try_parse_json(c)), F.col(c))).otherwise(F.col(c))
    named = F.array(*(F.struct(F.lit(name).alias("name"), c.alias("value")) for name, c in (("instance_data.json", F.col("record")), ("test.patch", patch("test_patch")), ("fix.patch", patch("patch")))))
    return instances.select("instance_id", F.inline(named)).filter("value is not null")


def write_metadata(instances: DataFrame, path: str) -> None:
    """The files of ``metadata_files`` below <path>/instance_id=../name=..."""
    metadata_files(instances).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instance_id", "name").text(path)
