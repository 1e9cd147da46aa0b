"""Message logs: steps, pages, rendering, access events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import PATH_PATTERN, SOURCE_SUFFIXES, is_source_file, lines, normalise_path, strip

_EXT = "(?:" + "|".join(x.replace(".", r"\.") for x in SOURCE_SUFFIXES) + ")"


def steps(messages: DataFrame, key: str = "instance_id", pos: str = "pos", marker: Column | None = None) -> DataFrame:
    """Assistant messages directly followed by a user message that passes ``marker``, with dense indices.

    One window: rows of a log are ordered once and each looks one row ahead.
    """
    w = Window.partitionBy(key).orderBy(pos)
    seen = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("observation", F.lead("content").over(w))
    ok = marker if marker is not None else F.col("observation").contains("<returncode>")
    kept = seen.filter((F.col("role") == "assistant") & (F.col("next_role") == "user") & ok)
    return kept.withColumn("step_index", F.row_number().over(w) - 1).select(key, "step_index", pos, "content", "observation")


def pages(messages: DataFrame, key: str = "instance_id", pos: str = "pos") -> DataFrame:
    """Messages with their page: a page ends at each user message."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("page", F.coalesce(F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w), F.lit(0)))


def render(step_rows: DataFrame, key: str = "instance_id") -> DataFrame:
    """One text per log: a header per step with its thought and action; silent steps are left out."""
    said = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"[{label}] "), F.col(c)))
    body = F.concat_ws("\n", F.concat(F.lit("=== Step "), F.col("step_index").cast("string"), F.lit(" ===")), said("Thought", "thought"), said("Action", "action"), F.lit(""))
    spoken = (F.coalesce(F.col("thought"), F.lit("")) != "") | (F.coalesce(F.col("action"), F.lit("")) != "")
    parts = step_rows.filter(spoken).select(key, F.struct("step_index", body.alias("body")).alias("part"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["body"]), "\n").alias("text"))


def _event(kind: str, path: Column, start: Column | None = None, end: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(normalise_path(path).alias("filepath"), F.lit(kind).alias("access_type"), (none if start is None else start.try_cast("int")).alias("start_line"), (none if end is None else end.try_cast("int")).alias("end_line"))


def _one(cond: Column, event: Column) -> Column:
    empty = F.filter(F.array(event), lambda _: F.lit(False))
    return F.when(cond, F.array(event)).otherwise(empty)


def accesses(step_rows: DataFrame) -> DataFrame:
    """Code-access events of (.., action, observation) rows: one array per rule, joined and exploded."""
    a, seen = F.coalesce(F.col("action"), F.lit("")), F.coalesce(F.col("observation"), F.lit(""))
    out_lines = lines(seen)
    group = lambda pattern, i: F.regexp_extract(a, pattern, i)
    has = lambda pattern: a.rlike(pattern)
    path = PATH_PATTERN
    found = F.transform(F.filter(F.transform(out_lines, strip), is_source_file), lambda x: _event("SEARCH", x))
    find = F.when(a.contains("find ") & seen.rlike(_EXT), found).otherwise(F.filter(found, lambda _: F.lit(False)))
    grep_re = r"""grep\s+(?:-[\p{L}\p{N}_]+\s+)*["']?([^"']+)["']?\s+(\S+)"""
    target = F.when(has(grep_re), group(grep_re, 2)).otherwise(F.when(is_source_file(group(r"(\S+)\s*$", 1)), group(r"(\S+)\s*$", 1)).otherwise(""))
    named, bare = rf"^(\S+{_EXT}):(\d+):", r"^(\d+):"
    hits = F.transform(
        F.filter(out_lines, lambda x: x.rlike(named) | x.rlike(bare)),
        lambda x: F.when(x.rlike(named), _event("SEARCH", F.regexp_extract(x, named, 1), F.regexp_extract(x, named, 2), F.regexp_extract(x, named, 2))).otherwise(_event("SEARCH", target, F.regexp_extract(x, bare, 1), F.regexp_extract(x, bare, 1))),
    )
    grep = F.when(a.contains("grep ") & (F.size(hits) > 0), hits).otherwise(_one(a.contains("grep ") & (target != ""), _event("SEARCH", target)))
    span, line = r"""sed\s+-n\s+['"]?(\d+),(\d+)p['"]?\s+(\S+)""", r"""sed\s+-n\s+['"]?(\d+)p['"]?\s+(\S+)"""
    viewing = a.contains("sed -n") | a.contains("sed  -n")
    view = F.when(has(span), _one(viewing, _event("VIEW", group(span, 3), group(span, 1), group(span, 2)))).otherwise(_one(viewing & has(line), _event("VIEW", group(line, 2), group(line, 1), group(line, 1))))
    # Fixed values, as the commands above and below: numbered views of a range or of one line.
    nl = rf"""nl\s+(?:-[\p{{L}}\p{{N}}_]+\s+)*({path})\s*\|\s*sed\s+-n\s+['"]?(\d+)"""
    nl_span, nl_line = nl + r",(\d+)p", nl + "p"
    piped = a.contains("nl ") & a.contains("sed -n")
    numbered = F.when(has(nl_span), _one(piped, _event("VIEW", group(nl_span, 1), group(nl_span, 2), group(nl_span, 3)))).otherwise(_one(piped & has(nl_line), _event("VIEW", group(nl_line, 1), group(nl_line, 2), group(nl_line, 2))))
    cat = _one(has(rf"\bcat\s+({path})") & a.contains("cat ") & ~a.contains("sed -n"), _event("VIEW", group(rf"\bcat\s+({path})", 1)))
    top, end = rf"\bhead\s+-n\s+(\d+)\s+({path})", rf"\btail\s+-n\s+(\d+)\s+({path})"
    ends = a.contains("head ") | a.contains("tail ")
    head = _one(ends & has(top), _event("VIEW", group(top, 2), F.lit("1"), group(top, 1)))
    tail = _one(ends & has(end) & ~has(top), _event("VIEW", group(end, 2)))
    inplace, at = rf"sed\s+-i\s+.*\s+({path})", r"""sed\s+-i\s+['"]?(\d+)(?:,(\d+))?"""
    edit = _one(has(inplace) & (a.contains("sed -i") | a.contains("sed  -i")), _event("EDIT", group(inplace, 1), group(at, 1), F.coalesce(F.nullif(group(at, 2), F.lit("")), group(at, 1))))
    events = F.concat(find, grep, view, numbered, cat, head, tail, edit)
    return step_rows.select(*step_rows.columns, F.posexplode(events).alias("rule_pos", "e")).select(*step_rows.columns, "rule_pos", "e.*")
