"""Texts shown to models and agents: skills, experiences, prompts; and marks on messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import clean_statement, strip

# Headings and sentences of the texts.
GLOBAL_HEAD = "=== Global Diagnostic Skills ==="
LOCAL_HEAD = "=== Local Intervention Skills ==="
EXPERIENCE_HEAD = "You can refer to these domain-specific knowledge to fix this task:"
STRATEGIES_HEAD = "Strategies that worked for similar issues:"
ISSUE_ASK = ("Summarize the issue into a structured JSON object.", "Use the golden patch and tests to identify the root requirement.", "Return ONLY a JSON object.")
TASK_LINES = {
    "local": ("Return a JSON ARRAY only. Each item: api_path, experience_or_reflection, thinking.", "api_path MUST be from Candidate API Paths."),
    "global": (
        "Return a JSON ARRAY only. Each item: api_path, purpose, playbook, related_apis, thinking.",
        "api_path and related_apis MUST be from Candidate API Paths.",
        'related_apis: array of {"api_path": "...", "reason": "..."} objects.',
    ),
}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _joined(*parts: Column | str) -> Column:
    """Lines joined; a part is one line or an array of them."""
    return F.array_join(F.concat(*(F.array(F.lit(p)) if isinstance(p, str) else p for p in parts)), "\n")


def _gathered(rows: DataFrame, by: list[str], order: list[str], lines: Column, name: str) -> DataFrame:
    """Per group the lines of its rows, in order."""
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, lines.alias("_l")))).alias("_h"))
    return held.select(*by, F.flatten(F.transform("_h", lambda x: x["_l"])).alias(name))


def global_skills(tasks: DataFrame, items: DataFrame, key: str, order: list[str], most: int = 5) -> DataFrame:
    """(key, text): each (key, task) with its first ``most`` items (key, order, api_path, purpose, playbook).

    Items without a path or purpose are left out after the cut, so fewer may show. The cut is a ranked window, so no more than
    ``most`` items of a key are ever gathered.
    """
    w = Window.partitionBy(key).orderBy(*order)
    top = items.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= most).filter((_text(F.col("api_path")) != "") & (_text(F.col("purpose")) != ""))
    play = strip(_text(F.col("playbook")))
    shown = F.array_compact(F.array(F.concat(F.lit("- "), "api_path", F.lit(": "), "purpose"), F.when(play != "", F.concat(F.lit("  - playbook: "), play))))
    listed = _gathered(top, [key], ["_i"], shown, "_lines")
    none = F.array().cast("array<string>")
    return tasks.join(listed, key, "left").select(key, strip(_joined(F.array(_text(F.col("task"))), "", GLOBAL_HEAD, F.coalesce("_lines", none))).alias("text"))


def local_skills(fired: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, text) of skills that fired together: (by, api_path, order, experience_or_reflection, issue), by path, then order.

    Blank experiences show no line, but their path does.
    """
    said, issue = strip(_text(F.col("experience_or_reflection"))), strip(_text(F.col("issue")))
    line = F.when(said == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("- "), F.when(issue != "", F.concat(F.lit("["), issue, F.lit("] "))).otherwise(""), said)))
    paths = _gathered(fired, [*by, "api_path"], order, line, "_lines")
    block = F.concat(F.array(F.concat(F.lit("API: "), "api_path")), "_lines", F.array(F.lit("")))
    return _gathered(paths, by, ["api_path"], block, "_blocks").select(*by, strip(_joined(LOCAL_HEAD, F.col("_blocks"))).alias("text"))


def experience_text(kind: Column, strategies: Column, missing: Column, approach: Column) -> Column:
    """An experience of the older form: numbered strategies of a success, or what a failure lacked and the right approach.

    ``missing``: array of struct(description, suggested_resources); a plain item is a description alone.
    """
    numbered = F.transform(strategies, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s))
    lacked = F.flatten(
        F.transform(
            missing,
            lambda m: F.array_compact(
                F.array(F.concat(F.lit("  - "), _text(m["description"])), F.when(_text(m["suggested_resources"]) != "", F.concat(F.lit("    Suggested resources: "), m["suggested_resources"])))
            ),
        )
    )
    none = F.array().cast("array<string>")
    success = F.when(F.size(strategies) > 0, F.concat(F.array(F.lit(STRATEGIES_HEAD)), numbered)).otherwise(none)
    failure = F.concat(F.coalesce(lacked, none), F.array(F.concat(F.lit("Correct approach: "), _text(approach))))
    body = F.when(kind == "success_experience", success).when(kind == "failure_reflection", failure).otherwise(none)
    return _joined(EXPERIENCE_HEAD, "", body)


def issue_prompt(statement: Column, tests: Column, patch: Column) -> Column:
    """The request to summarise an issue."""
    tagged = lambda tag, body: F.array(F.lit(""), F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))
    first, second, last = ISSUE_ASK
    return _joined(first, second, tagged("problem_statement", clean_statement(statement)), tagged("test_cases_or_test_patch", _text(tests)), tagged("golden_patch", _text(patch)), "", last)


def skills_prompt(form: str, instance: Column, resolved: Column, statement: Column, patch: Column, golden: Column, tests: Column, trajectory: Column, candidates: Column, most: int = 10) -> Column:
    """The request for ``local`` or ``global`` skills; golden parts only where the run isn't resolved."""
    part = lambda head, body: F.array(F.lit(f"=== {head} ==="), _text(body), F.lit(""))
    facts = F.array(F.concat(F.lit("instance_id: "), instance), F.concat(F.lit("resolved: "), resolved.cast("string")), F.lit(""))
    hidden = F.when(resolved, F.array().cast("array<string>")).otherwise(F.concat(part("Golden Patch (unresolved only)", golden), part("Golden Tests (unresolved only)", tests)))
    paths = F.transform(candidates, lambda c: F.concat(F.lit("- "), c))
    task = F.array(F.lit(""), F.lit("=== Task ==="), *map(F.lit, TASK_LINES[form]), F.lit(f"Output top {most} items."))
    return _joined("=== Instance ===", facts, part("Problem Statement", statement), part("Candidate Patch", patch), hidden, part("Agent Trajectory", trajectory), "=== Candidate API Paths (STRICT) ===", paths, task)


def mark_last(messages: DataFrame, key: str = "instance_id", pos: str = "pos") -> DataFrame:
    """Messages with ``cache_mark``: where a log's last one carries its cache mark, ``entry`` for a tool, else ``content``; null before it."""
    later = F.lead(pos).over(Window.partitionBy(key).orderBy(pos))
    return messages.withColumn("_later", later).withColumn("cache_mark", F.when(F.col("_later").isNull(), F.when(F.col("role") == "tool", "entry").otherwise("content"))).drop("_later")
