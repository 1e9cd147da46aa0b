"""Line ranges aligned with code scopes, counts and candidate ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.ids import scope_key
from runlens.functions.text import is_source_file, is_test_file

SPECIFICITY = {"function": 3, "class": 2, "file": 1}


#: Lines of a bin.
BIN = 32


def align(ranges: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scopes hit by each (range_id, filepath, start_line, end_line); no hit or a null range gives the bare file.

    Every distinct set of spans is aligned once with every distinct scope, then each range takes the scopes of its set,
    so the joins grow with the kinds of ranges and the rows with the result. The spans of rows that share a range_id are one set.
    An equi join on the file and a bin of lines: both sides are listed in each bin they touch, and a pair counts in its
    first common bin alone. A class counts only where none of its methods was hit; the left join's default is the file itself.
    """
    first_bin = lambda c: F.floor(F.col(c) / BIN)
    bins = lambda a, b: F.explode(F.sequence(first_bin(a), first_bin(b))).alias("bin")
    s = scopes.select("filepath", F.col("class_name").alias("c"), F.col("function_name").alias("f"), F.col("start_line").alias("s"), F.col("end_line").alias("e")).filter("s <= e").distinct()
    span = F.when(F.expr("range_id is not null and filepath is not null and start_line <= end_line"), F.struct("filepath", "start_line", "end_line"))
    apart = F.when(F.col("range_id").isNull(), F.xxhash64("filepath", "start_line", "end_line"))  # null ids share nothing: not in one task
    w = Window.partitionBy("range_id", apart)
    asked = ranges.select("range_id", "filepath", F.array_sort(F.collect_set(span).over(w)).alias("spans"))
    kinds = asked.filter(F.size("spans") > 0).select("spans", F.col("filepath").alias("path")).distinct()
    each = kinds.select("spans").distinct().select("spans", F.inline("spans"))
    hits = each.select("*", bins("start_line", "end_line")).join(s.select("*", bins("s", "e")), ["filepath", "bin"]).filter("s <= end_line and start_line <= e")
    hits = hits.filter(F.col("bin") == F.greatest(first_bin("start_line"), first_bin("s"))).select("spans", "c", "f").distinct()
    of_class = Window.partitionBy("spans", "c")
    kept = hits.withColumn("methods", F.when(F.col("c").isNotNull(), F.count("f").over(of_class)).otherwise(0)).filter("f is not null or methods = 0")
    kept = kept.join(kinds, "spans").groupBy("spans", "path").agg(F.collect_list(F.struct(F.col("c").alias("class_name"), F.col("f").alias("function_name"), scope_key(F.col("path"), F.col("c"), F.col("f")).alias("scope_key"))).alias("hits"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("class_name"), F.lit(None).cast("string").alias("function_name"), scope_key(F.col("filepath"), F.lit(None), F.lit(None)).alias("scope_key")))
    rows = asked.join(kept, (asked["spans"] == kept["spans"]) & asked["filepath"].eqNullSafe(kept["path"]), "left")
    return rows.select("range_id", "filepath", F.inline(F.coalesce("hits", none)))


def rank_candidates(counts: DataFrame, most: int = 200, key: str = "instance_id") -> DataFrame:
    """(key, scope_key, kind, count) rows ranked by count, then specificity, then key; ``most`` below 1 keeps one."""
    level = F.create_map(*(F.lit(x) for kv in SPECIFICITY.items() for x in kv))
    merged = counts.groupBy(key, "scope_key").agg(F.max("count").alias("count"), F.max(level[F.col("kind")]).alias("specificity"))
    w = Window.partitionBy(key).orderBy(F.desc("count"), F.desc("specificity"), "scope_key")
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, most))


def line_islands(executed: DataFrame, by: list[str], line: str = "line", least: int = 3) -> DataFrame:
    """Runs of consecutive lines of at least ``least`` lines."""
    w = Window.partitionBy(*by).orderBy(line)
    marked = executed.select(*by, line).distinct().withColumn("island", F.col(line) - F.row_number().over(w))
    out = marked.groupBy(*by, "island").agg(F.min(line).alias("start_line"), F.max(line).alias("end_line"), F.count("*").alias("n_lines"))
    return out.filter(F.col("n_lines") >= least).drop("island")


def segments(executed: DataFrame, functions: DataFrame, by: list[str], most: int = 120, least: int = 3) -> DataFrame:
    """Functions of at most ``most`` lines that meet the span of executed lines; files with none give islands."""
    span = executed.groupBy(*by).agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    chosen = functions.join(span, by).filter((F.col("start_line") <= F.col("hi")) & (F.col("end_line") >= F.col("lo")) & (F.col("end_line") - F.col("start_line") + 1 <= most))
    chosen = chosen.select(*by, "start_line", "end_line", F.lit("function").alias("kind"))
    rest = line_islands(executed.join(chosen.select(*by).distinct(), by, "left_anti"), by, least=least)
    return chosen.unionByName(rest.select(*by, "start_line", "end_line", F.lit("block").alias("kind")))


def go_coverage(profile: DataFrame, module: str) -> DataFrame:
    """(file, line) of executed statements in ``file:l.c,l.c n count`` rows of column ``value``."""
    row = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$"
    g = lambda i: F.regexp_extract("value", row, i)
    rows = profile.filter(F.col("value").rlike(row)).select(F.regexp_replace(g(1), F.concat(F.lit("^"), F.lit("\\Q" + module + "/\\E")), F.lit("")).alias("file"), g(2).cast("int").alias("a"), g(3).cast("int").alias("b"), g(4).cast("bigint").alias("n"))
    return rows.filter("n > 0 and a <= b and not endswith(file, '_test.go')").select("file", F.explode(F.sequence("a", "b")).alias("line")).distinct()


def jest_coverage(reports: DataFrame, root: str = "") -> DataFrame:
    """(file, line) from Jest's JSON report in column ``value``: statements that ran, line by line."""
    loc = "struct<line:int>"
    shape = f"map<string,struct<statementMap:map<string,struct<start:{loc},end:{loc}>>,s:map<string,bigint>>>"
    files = reports.select(F.explode(F.from_json("value", shape)).alias("file", "r"))
    stm = files.select("file", "r.s", F.explode("r.statementMap").alias("id", "at")).select("file", F.col("at.start.line").alias("a"), F.col("at.end.line").alias("b"), F.try_element_at("s", F.col("id")).alias("n"))
    inside = stm.filter(F.col("file").startswith(root) & ~F.col("file").rlike(r"\.test\.|\.spec\.|node_modules"))
    return inside.filter("n > 0 and a > 0 and a <= b").select(F.substr("file", F.lit(len(root) + 1)).alias("file"), F.explode(F.sequence("a", "b")).alias("line")).distinct()


def python_coverage(reports: DataFrame) -> DataFrame:
    """(file, line) from coverage.py's JSON in column ``value``; test files are left out."""
    files = reports.select(F.explode(F.from_json("value", "struct<files:map<string,struct<executed_lines:array<int>>>>")["files"]).alias("file", "r"))
    return files.filter(~F.col("file").rlike(r"test_|tests/|_test\.py")).select("file", F.explode("r.executed_lines").alias("line")).distinct()


def candidate_files(accessed: DataFrame, extra: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, filepath): accessed and further files, once each, that are source and not tests."""
    both = accessed.select(key, "filepath").union(extra.select(key, "filepath"))
    return both.filter(is_source_file(F.col("filepath")) & ~is_test_file(F.col("filepath"))).distinct()


def access_counts(aligned: DataFrame, extra: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, scope_key, count) of accesses (key, filepath, scope_key) to source files; further files enter with 0."""
    wanted = is_source_file(F.col("filepath")) & ~is_test_file(F.col("filepath"))
    seen = aligned.filter(wanted).select(key, "scope_key", F.lit(1).alias("n"))
    more = extra.filter(wanted).select(key, F.col("filepath").alias("scope_key"), F.lit(0).alias("n"))
    return seen.union(more).groupBy(key, "scope_key").agg(F.sum("n").alias("count"))
