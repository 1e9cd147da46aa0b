"""Skill tables: aggregation by repository, leakage filters, admission, injection, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.ids import file_of, number_of, repo_of


def aggregate_by_repo(records: DataFrame, id_col: str = "instance_id") -> DataFrame:
    """(id, line_no, items array) -> repo_id and its items in (line, item) order, each with its source id."""
    items = records.filter(F.coalesce(F.col(id_col), F.lit("")) != "").select(F.col(id_col).alias("source_instance_id"), repo_of(F.col(id_col)).alias("repo_id"), "line_no", F.posexplode("items").alias("item_no", "item"))
    ordered = items.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "item_no", "source_instance_id", "item"))).alias("items"))
    return ordered.select("repo_id", F.transform("items", lambda x: F.struct(x["source_instance_id"].alias("source_instance_id"), x["item"].alias("item"))).alias("items"))


def merge_tables(local: DataFrame, other: DataFrame, key: str = "repo_id") -> DataFrame:
    """All keys of both sides with both item arrays; a missing side is empty."""
    both = local.withColumnRenamed("items", "local_items").join(other.withColumnRenamed("items", "global_items"), key, "full_outer")
    return both.select(key, *(F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType)).alias(c) for c in ("local_items", "global_items")))


def override(plain: DataFrame, synthesized: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two maps; the second wins per key."""
    return plain.withColumnRenamed(value, "_p").join(synthesized.withColumnRenamed(value, "_s"), key, "full_outer").select(key, F.coalesce("_s", "_p").alias(value))


def least_numbers(eval_ids: DataFrame) -> DataFrame:
    """Least evaluation number per repository; ids without a number set none."""
    n = number_of(F.col("instance_id"))
    return eval_ids.select(repo_of(F.col("instance_id")).alias("repo"), n.alias("n")).filter("n <> 0").groupBy("repo").agg(F.min("n").alias("least"))


def drop_exact(items: DataFrame, eval_ids: DataFrame) -> DataFrame:
    return items.join(eval_ids.select(F.col("instance_id").alias("source_instance_id")).distinct(), "source_instance_id", "left_anti")


def drop_temporal(items: DataFrame, eval_ids: DataFrame) -> DataFrame:
    """Keep items whose original number is at most the least evaluation number of its repository."""
    named = items.withColumn("repo", repo_of(F.col("original_instance_id")))
    return named.join(least_numbers(eval_ids), "repo", "left").filter(F.col("least").isNull() | (number_of(F.col("original_instance_id")) <= F.col("least"))).drop("repo", "least")


def drop_leaks(items: DataFrame, eval_ids: DataFrame) -> DataFrame:
    return drop_temporal(drop_exact(items, eval_ids), eval_ids)


#: Current instances that an item meets at once, and parts of a repository's items that go to tasks of their own.
MET, SPREAD = 512, 64


def admitted(items: DataFrame, current: DataFrame) -> DataFrame:
    """(current_id, item): items of the current instance's repository numbered no later than it; their numbers as ``num`` and ``now``.

    The result may be all pairs of a repository. Ids are read before they are paired; current instances lie in arrays of at most
    ``MET`` in the order of their numbers, each met by an item only if its last is late enough, and a repository's items are dealt over tasks.
    """
    now = current.select("current_id", repo_of(F.col("current_id")).alias("repo"), number_of(F.col("current_id")).alias("now")).filter("repo is not null and now is not null")
    w = Window.partitionBy("repo").orderBy("now")
    listed = now.withColumn("_at", F.floor((F.row_number().over(w) - 1) / MET)).groupBy("repo", "_at").agg(F.array_sort(F.collect_list(F.struct("now", "current_id"))).alias("_met"))
    listed = listed.select("repo", F.element_at("_met", -1)["now"].alias("_last"), "_met", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"))
    source = F.coalesce("original_instance_id", "source_instance_id")
    named = items.withColumn("repo", repo_of(source)).withColumn("num", number_of(source))
    named = named.withColumn("_part", F.pmod(F.xxhash64(*items.columns), F.lit(SPREAD)).cast("int")).repartition(4 * SPREAD, "repo", "_part")
    met = named.join(listed, ["repo", "_part"]).filter("num <= _last")
    return met.select("repo", *items.columns, "num", F.inline("_met")).filter("num <= now").select("repo", *items.columns, "num", "current_id", "now")


def first_injections(mentions: DataFrame, items: DataFrame, selected: DataFrame) -> DataFrame:
    """(run_id, api_path, pos): the first action that mentions the file of an item whose source was selected.

    ``mentions``: (run_id, pos, filepath). All items of an api path fire together, once per run.
    """
    paths = items.join(selected.select("source_instance_id").distinct(), "source_instance_id", "left_semi").select("api_path", file_of(F.col("api_path")).alias("filepath")).distinct()
    return mentions.join(paths, "filepath").groupBy("run_id", "api_path").agg(F.min("pos").alias("pos"))


def _entries() -> Column:
    return F.try_variant_get(F.try_parse_json("response"), "$", "array<variant>")


def _string(v: Column, path: str = "$") -> Column:
    """The string at a path of a variant, null where another type stands or nothing."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _or_empty(v: Column, key: str) -> Column:
    """A string that may be left out, then empty; null where another type stands."""
    return F.when(F.try_variant_get(v, f"$.{key}", "variant").isNull(), "").otherwise(_string(v, f"$.{key}"))


def _known(path: Column) -> Column:
    return F.coalesce(F.array_contains("candidates", path), F.lit(False))


def valid_local(rows: DataFrame) -> DataFrame:
    """(.., response, candidates) with ``items``: the parsed skills, null unless every one has a known path and two strings (empty ones too)."""
    fields = ("api_path", "experience_or_reflection", "thinking")
    items = F.transform(_entries(), lambda v: F.struct(*(_string(v, f"$.{k}").alias(k) for k in fields)))
    ok = F.forall(items, lambda s: _known(s["api_path"]) & s["experience_or_reflection"].isNotNull() & s["thinking"].isNotNull())
    return rows.withColumn("items", F.when(ok & (F.size(items) > 0), items))


def valid_global(rows: DataFrame) -> DataFrame:
    """As ``valid_local`` for global skills: a purpose, and optionally playbook, thinking and a list of related paths, strings or objects."""

    def related(v: Column) -> Column:
        one = lambda r: F.struct(F.coalesce(_string(r), _string(r, "$.api_path")).alias("api_path"), F.when(_string(r).isNotNull(), "").otherwise(_or_empty(r, "reason")).alias("reason"))
        listed = F.try_variant_get(v, "$.related_apis", "array<variant>")
        none = F.when(F.try_variant_get(v, "$.related_apis", "variant").isNull(), F.array().cast("array<struct<api_path:string,reason:string>>"))
        return F.coalesce(F.transform(listed, one), none)

    items = F.transform(
        _entries(),
        lambda v: F.struct(
            _string(v, "$.api_path").alias("api_path"), _string(v, "$.purpose").alias("purpose"), _or_empty(v, "playbook").alias("playbook"), _or_empty(v, "thinking").alias("thinking"), related(v).alias("related_apis")
        ),
    )
    whole = lambda s: s["purpose"].isNotNull() & s["playbook"].isNotNull() & s["thinking"].isNotNull() & s["related_apis"].isNotNull()
    ok = F.forall(items, lambda s: _known(s["api_path"]) & whole(s) & F.forall(s["related_apis"], lambda r: _known(r["api_path"]) & r["reason"].isNotNull()))
    return rows.withColumn("items", F.when(ok & (F.size(items) > 0), items))


# The kinds of a synthesized experience, current and older.
SYNTHESIZED = ("synthesized_experience", "domain2")


def is_synthesized(kind: Column) -> Column:
    return F.coalesce(kind.isin(*SYNTHESIZED), F.lit(False))


def with_source_ids(items: DataFrame, local: bool) -> DataFrame:
    """Items with the id they are admitted by filled in from ``record_id`` where they lack it.

    Local ones get ``instance_id``, or where the record has none their ``source_instance_id``; global ones ``source_instance_id``.
    """
    record = F.nullif(F.col("record_id"), F.lit(""))
    if local:
        return items.withColumn("instance_id", F.coalesce("instance_id", record, F.col("source_instance_id")))
    return items.withColumn("source_instance_id", F.coalesce("source_instance_id", record))


def published(items: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Items without their ids; local ones, given ``selected`` ids, only of those."""
    if selected is not None:
        items = items.join(selected.select("instance_id").distinct(), "instance_id", "left_semi")
    return items.drop("source_instance_id", "instance_id")


def with_golden(runs: DataFrame, golden: DataFrame, key: str = "instance_id", strict: bool = True) -> DataFrame:
    """Runs with their golden records; a run without one ends the query if ``strict``, else its fields are null."""
    found = runs.join(golden.withColumn("_found", F.lit(True)), key, "left")
    known = F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no golden record for "), F.col(key).cast("string"))).cast(runs.schema[key].dataType))
    return (found.withColumn(key, known) if strict else found).drop("_found")
