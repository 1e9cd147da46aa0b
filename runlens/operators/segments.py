"""Segments of traced code: traces and calls, texts of lines, context, rankings, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of paths that aren't traced, below the repository and anywhere.
UNTRACED = ("tests/", "test_", "venv/", "site-packages/")
FOREIGN = ("site-packages", "dist-packages", "__pycache__")


def traced(path: Column, repo: str, stdlib: tuple[str, ...] = (), drop: tuple[str, ...] = UNTRACED) -> Column:
    """Whether an absolute, resolved path is traced: source in ``repo``, not installed, not compiled, of no dropped pattern below it."""
    inside = F.substr(path, F.lit(len(repo) + 1))
    out = (path != "") & path.startswith(repo) & ~path.endswith(".pyc")
    for root in stdlib:
        out = out & ~path.startswith(root)
    for part in FOREIGN:
        out = out & ~path.contains(part)
    for part in drop:
        out = out & ~F.ltrim(inside, F.lit("/")).contains(part)
    return F.coalesce(out, F.lit(False))


def call_counts(calls: DataFrame, by: list[str], path: str = "path", function: str = "function") -> DataFrame:
    """(by, call, n, total): calls per ``path::function`` and in all of a trace."""
    counted = calls.groupBy(*by, F.concat(path, F.lit("::"), function).alias("call")).agg(F.count("*").alias("n"))
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))


def file_lines(content: Column) -> Column:
    """Lines with their ends as \\n, as Python reads a file; nothing after the last end."""
    parts = F.split(F.regexp_replace(F.coalesce(content, F.lit("")), r"\r\n?", "\n"), r"(?<=\n)")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_texts(executed: DataFrame, files: DataFrame, by: str = "filepath") -> DataFrame:
    """(by, line, code) of executed (by, line) rows that the file has, right-trimmed.

    The lines of a file are gathered first, so each content is split once and only asked lines are exploded.
    """
    asked = executed.select(by, F.col("line").cast("int").alias("line")).distinct().groupBy(by).agg(F.collect_list("line").alias("_asked"))
    found = files.join(asked, by).select(by, "_asked", file_lines(F.col("content")).alias("_l"))
    rows = found.select(by, F.explode(F.transform(F.filter("_asked", lambda n: (n > 0) & (n <= F.size("_l"))), lambda n: F.struct(n.alias("line"), F.get("_l", n - 1).alias("code")))).alias("r"))
    return rows.select(by, "r.line", F.regexp_replace("r.code", r"[\p{Z}\t-\r\x1c-\x1f\x85]+\z", "").alias("code"))


def with_context(segments: DataFrame, files: DataFrame, by: str = "filepath", context: int = 10) -> DataFrame:
    """Segments (by, start_line, end_line) with code, up to ``context`` lines before and after, and the first line's indent."""
    lined = segments.join(files.select(by, file_lines(F.col("content")).alias("_l")), by)
    start, end, n = F.col("start_line").cast("int"), F.col("end_line").cast("int"), F.size("_l")
    cut = lambda a, b: F.array_join(F.when(b >= a, F.slice("_l", a, b - a + 1)).otherwise(F.array().cast("array<string>")), "")
    first = F.coalesce(F.get("_l", start - 1), F.lit(""))
    indent = F.length(first) - F.length(F.regexp_replace(first, r"^[\p{Z}\t-\r\x1c-\x1f\x85]+", ""))
    return lined.select(
        *segments.columns,
        (end - start + 1).alias("line_count"),
        F.regexp_replace(cut(start, end), r"\n+\z", "").alias("code"),
        cut(F.greatest(F.lit(1), start - context), F.least(start - 1, n)).alias("context_before"),
        cut(end + 1, F.least(n, end + context)).alias("context_after"),
        indent.alias("base_indent"),
    )


def ranked_segments(rankings: DataFrame, segments: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """Segments (by, ord from 1, ..) named by the first ``most`` rankings (by, pos, segment_id, ..); those out of range name none."""
    w = Window.partitionBy(*by).orderBy("pos")
    first = rankings.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= most).drop("_i")
    return first.join(segments.withColumnRenamed("ord", "segment_id"), [*by, "segment_id"])


def longest_segments(segments: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """Where no ranking can be read: the ``most`` longest, the earlier of equal ones first."""
    w = Window.partitionBy(*by).orderBy(F.desc("line_count"), "ord")
    return segments.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def segment_totals(bugs: DataFrame, attempts: DataFrame, by: list[str]) -> DataFrame:
    """(by, bugs_count, files_modified sorted, total_attempts): every group with an attempt or a bug."""
    made = bugs.groupBy(*by).agg(F.count("*").alias("_b"), F.array_sort(F.collect_set("filepath")).alias("_f"))
    tried = attempts.groupBy(*by).agg(F.count("*").alias("_t"))
    none = F.array().cast("array<string>")
    return tried.join(made, by, "full_outer").select(*by, F.coalesce("_b", F.lit(0)).alias("bugs_count"), F.coalesce("_f", none).alias("files_modified"), F.coalesce("_t", F.lit(0)).alias("total_attempts"))


def ordered_distinct(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Each value of a group once, at its first place."""
    return rows.groupBy(*by, value).agg(F.min(order).alias(order))


# How tests are written in Go and in scripts, and how files of the latter are named.
GO_TEST = r"(?m)^func\s+(Test[\p{L}\p{N}_]+)\s*\("
SCRIPT_TEST = r"""(?:it|test|describe)\s*\(\s*['"`]([^'"`]+)['"`]"""
SCRIPT_FILE = r"\.(?:test\.ts|spec\.ts|test\.tsx|spec\.tsx|test\.js|spec\.js)$"


def test_names(files: DataFrame) -> DataFrame:
    """(test_id, filepath, ord) of the tests in (filepath, content) rows, each id once: of Go by folder, of scripts by file."""
    path, body = F.col("filepath"), F.coalesce("content", F.lit(""))
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    go = F.when(path.endswith("_test.go"), F.transform(F.regexp_extract_all(body, F.lit(GO_TEST), F.lit(1)), lambda t: F.concat(F.when(folder != "", F.concat(F.lit("./"), folder)).otherwise("."), F.lit("::"), t)))
    listed = path.rlike(SCRIPT_FILE) & ~F.concat(F.lit("/"), path).contains("/node_modules/")
    script = F.when(listed, F.transform(F.regexp_extract_all(body, F.lit(SCRIPT_TEST), F.lit(1)), lambda t: F.concat(path, F.lit("::"), F.trim(t))))
    named = files.select("filepath", F.posexplode(F.coalesce(go, script)).alias("ord", "test_id"))
    first = named.groupBy("test_id").agg(F.min(F.struct("filepath", "ord")).alias("f"))
    return first.select("test_id", "f.filepath", "f.ord")
