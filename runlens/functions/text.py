"""Text functions as columns: tokenising, cleaning, parsing of messages and paths. No Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of source files, and what marks a test file.
SOURCE_SUFFIXES = (".tsx", ".jsx", ".py", ".go", ".ts", ".js")
TEST_MARKERS = ("/tests/", "/test/", "__tests__/", ".test.", ".spec.", "_test.go")
SUBMIT = "COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT"
SUBMIT_LEGACY = "MINI_SWE_AGENT_FINAL_OUTPUT"
#: What Python's str.strip() and str.split() take as white space, as a Java class.
SPACE = r"[\p{Z}\t-\r\x1c-\x1f\x85]"
#: Where Python's str.splitlines() cuts.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# The shape of a source path, and the patterns taken out of issue texts.
PATH_PATTERN = r"(?:(?:/|\./)?[\p{L}\p{N}_.\-@]+/)*[\p{L}\p{N}_.\-@]+(?:\.tsx|\.jsx|\.py|\.go|\.ts|\.js)"
STATEMENT_DROPS = ((r"(?s)```.*?```", " "), (r"https?://\S+", " "), (r"(?m)^#+\s*.*$", " "), (r"(?m)^\*\*.*?\*\*\s*$", " "), (r"(?mi)^\s*(?:thanks|thank you).*$", " "))
FOCUS_DROPS = ((r"(?s)```.*?```", " "), (r"(?m)^#+\s*", ""), (r"(?m)^\*\*.*?\*\*\s*:?\s*$", " "), (r"\*\*(.*?)\*\*", "$1"), (r"https?://\S+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after the last end."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def retrieval_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))


def copy_tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two distinct arrays; 0 where a side is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def is_copy(a: Column, b: Column, threshold: float = 0.75) -> Column:
    return jaccard(copy_tokens(a), copy_tokens(b)) >= threshold


def _squeezed(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def _without(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    for pattern, new in patterns:
        text = F.regexp_replace(text, pattern, new)
    return text


def clean_statement(text: Column, most: int = 1200) -> Column:
    """An issue's prose: without fences, links, headings, bold lines and thanks; cut, and right-trimmed only then."""
    bare = _squeezed(_without(F.coalesce(text, F.lit("")), STATEMENT_DROPS))
    return F.when(F.length(bare) > most, F.regexp_replace(F.substring(bare, 1, most), rf"{SPACE}+$", "")).otherwise(bare)


def normalise_focus(text: Column, most: int = 240) -> Column:
    """One line of prose: heading marks and bold marks go, their words stay; null where nothing is left."""
    bare = _squeezed(_without(F.coalesce(text, F.lit("")), FOCUS_DROPS))
    return F.nullif(F.substring(bare, 1, most), F.lit(""))


def format_focus(symptom: Column, expect: Column, constraints: Column) -> Column:
    said = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.when(F.coalesce(symptom, F.lit("")) != "", F.concat_ws(" | ", said("Symptom", symptom), said("Expect", expect), said("Constraints", constraints)))


_FENCE = "```"


def parse_message(content: Column) -> Column:
    """struct(thought, action): what stands before and in the first bash fence; an open fence runs to the end."""
    mark = _FENCE + "bash"
    at = F.instr(content, mark)
    rest = F.substr(content, at + len(mark))
    return F.when(at == 0, F.struct(content.alias("thought"), F.lit("").alias("action"))).otherwise(
        F.struct(strip(F.substr(content, F.lit(1), at - 1)).alias("thought"), strip(F.substring_index(rest, _FENCE, 1)).alias("action"))
    )


def parse_action(content: Column) -> Column:
    """struct(action, error): the text of the only bash fence, else a format error with the number of fences."""
    found = F.transform(F.regexp_extract_all(content, F.lit(r"(?s)```bash\s*\n(.*?)\n```"), F.lit(1)), strip)
    return F.struct(F.when(F.size(found) == 1, F.get(found, F.lit(0))).alias("action"), F.when(F.size(found) != 1, F.concat(F.lit("FormatError: "), F.size(found).cast("string"))).alias("error"))


def normalise_path(path: Column) -> Column:
    """Drop the first of /testbed/, ./ or /testbed that the path begins with, then all leading slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^(?:/testbed/|\./|/testbed)", ""), "^/+", "")


def is_source_file(path: Column) -> Column:
    out = F.lit(False)
    for suffix in SOURCE_SUFFIXES:
        out = out | path.endswith(suffix)
    return out


def is_test_file(path: Column) -> Column:
    path = F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")
    base = F.substring_index(path, "/", -1)
    out = base.startswith("test_") | base.endswith("_test.py") | base.endswith("_test.go")
    for marker in TEST_MARKERS:
        out = out | F.concat(F.lit("/"), path).contains(marker)
    return out


def path_mentions(text: Column) -> Column:
    """Distinct normalised paths that look like source files; the pattern is open to the right on purpose."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATH_PATTERN), F.lit(0)), normalise_path))


def diff_files(diff: Column) -> Column:
    """New names in the ``diff --git a/x b/y`` lines of a diff."""
    heads = F.filter(lines(F.coalesce(diff, F.lit(""))), lambda x: x.rlike(r"^diff --git \S+ \S+"))
    return F.transform(heads, lambda x: F.regexp_replace(F.get(F.split(x, r"\s+"), F.lit(3)), "^b/", ""))


def elide(text: Column, most: int = 10_000) -> Column:
    """Long output as its first and last half of ``most`` characters around a note of what is left out."""
    half = most // 2
    cut = F.concat(F.substring(text, 1, half), F.lit("\n<elided_chars>\n"), (F.length(text) - most).cast("string"), F.lit(" characters elided\n</elided_chars>\n"), F.right(text, F.lit(half)))
    return F.when(F.length(text) < most, text).otherwise(cut)


def shorten(text: Column, most: int, left: bool = False) -> Column:
    keep = most - 3
    cut = F.concat(F.lit("..."), F.right(text, F.lit(keep))) if left else F.concat(F.substring(text, 1, keep), F.lit("..."))
    return F.rpad(F.when(F.length(text) > most, cut).otherwise(text), most, " ")


def submission_state(output: Column) -> Column:
    """Submitted or continue, from the output's first line and what follows it."""
    body = F.regexp_replace(output, rf"^{SPACE}+", "")
    first = F.regexp_extract(body, r"^([^\n]*)", 1)
    rest = strip(F.substr(body, F.length(first) + 2))
    bad = rest.rlike("fatal:|error:")
    first = strip(first)
    return F.when((first == SUBMIT) & (rest != "") & ~bad, "Submitted").when((first == SUBMIT_LEGACY) & ~bad, "Submitted").otherwise("continue")


def code_block(text: Column) -> Column:
    """The first fenced block, without a python label, else all of the text; brackets are closed."""
    inner = F.regexp_extract(text, r"(?s)```(?:python)?\s*(.*?)```", 1)
    return close_brackets(strip(F.when(text.rlike(r"(?s)```.*?```"), inner).otherwise(text)))


def strip_fences(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def close_brackets(code: Column) -> Column:
    """Closers that are missing by count, in the order ), ], }, after `` else None`` where an inline condition dangles."""
    lacking = [(F.regexp_count(code, F.lit(a)) - F.regexp_count(code, F.lit(b)), b[-1]) for a, b in (("\\(", "\\)"), ("\\[", "\\]"), ("\\{", "\\}"))]
    dangling = (F.greatest(*(n for n, _ in lacking)) > 0) & code.contains(" if ") & ~code.contains(" else ")
    whole = F.when(dangling, F.concat(F.regexp_replace(code, rf"{SPACE}+\z", ""), F.lit(" else None"))).otherwise(code)
    return F.concat(whole, *(F.repeat(F.lit(closer), F.greatest(n, F.lit(0))) for n, closer in lacking))


def delimiters_balanced(code: Column, slack: int = 2) -> Column:
    """Whether no kind of bracket is off by more than ``slack``."""
    ok = F.lit(True)
    for a, b in (("\\(", "\\)"), ("\\[", "\\]"), ("\\{", "\\}")):
        ok = ok & (F.abs(F.regexp_count(code, F.lit(a)) - F.regexp_count(code, F.lit(b))) <= slack)
    return ok


def tail_lines(text: Column, n: int = 30) -> Column:
    parts = lines(text)
    return F.array_join(F.when(F.size(parts) > n, F.slice(parts, -n, n)).otherwise(parts), "\n")


def test_slug(test: Column) -> Column:
    return F.replace(F.replace(F.replace(test, F.lit("::"), F.lit("__")), F.lit("/"), F.lit("_")), F.lit("."), F.lit("_"))


def split_test_id(test: Column, default_dir: str = ".") -> Column:
    """struct(path, name) cut at the first ``::``."""
    has = F.instr(test, "::") > 0
    return F.struct(F.when(has, F.substring_index(test, "::", 1)).otherwise(default_dir).alias("path"), F.when(has, F.substr(test, F.instr(test, "::") + 2)).otherwise(test).alias("name"))


def listed_tests(listing: Column, strict: bool = True) -> Column:
    """Test ids of a collection listing, in order, once each, without parameters."""
    kept = F.filter(F.transform(lines(listing), strip), lambda x: x.contains(".py::") & (~x.rlike("^(?:=|-|no tests|<)") if strict else F.lit(True)))
    return F.array_distinct(F.transform(kept, lambda x: F.substring_index(x, "[", 1)))


def repo_slug(remote: Column) -> Column:
    return F.regexp_extract(remote, r"[/:]([^/:]+/[^/]+?)(?:\.git)?/?$", 1)


def relative_path(path: Column, root: Column) -> Column:
    inside = path.startswith(F.concat(root, F.lit("/")))
    return F.when(inside, F.substr(path, F.length(root) + 2)).otherwise(F.regexp_replace(path, "^repo/", ""))


def image_name(docker_image: Column, image: Column, instance_id: Column) -> Column:
    derived = F.lower(F.concat(F.lit("docker.io/swebench/sweb.eval.x86_64."), F.replace(instance_id, F.lit("__"), F.lit("_1776_")), F.lit(":latest")))
    return F.coalesce(F.nullif(docker_image, F.lit("")), image, derived)


def lenient_json(text: Column, top: str) -> Column:
    """A JSON value of the wanted top type (ARRAY or OBJECT) from the whole text, else from its first fence."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    typed = lambda v: F.when(F.schema_of_variant(v).startswith(top), v)
    return F.coalesce(typed(F.try_parse_json(text)), typed(F.try_parse_json(fenced)))


def _typed(v: Column, top: str) -> Column:
    return F.when(F.schema_of_variant(v).startswith(top), v)


def rankings(response: Column) -> Column:
    """array<variant>: the list in the first json fence, else from the first ``[`` to the last ``]``; empty where neither is one."""
    fenced = F.regexp_extract(response, r"(?s)```json\s*(.*?)\s*```", 1)
    span = F.regexp_extract(response, r"(?s)\[.*\]", 0)
    found = F.coalesce(_typed(F.try_parse_json(fenced), "ARRAY"), _typed(F.try_parse_json(span), "ARRAY"))
    return F.coalesce(F.try_variant_get(found, "$", "array<variant>"), F.array().cast("array<variant>"))


def says_resolved(response: Column) -> Column:
    """Whether the object from the first ``{`` to the last ``}`` has a ``resolved`` that counts as true; false where none can be read."""
    v = F.try_variant_get(F.try_parse_json(F.regexp_extract(response, r"(?s)\{.*\}", 0)), "$.resolved", "variant")
    kind = F.schema_of_variant(v)
    number = F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False))
    true = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind == "STRING", F.try_variant_get(v, "$", "string") != "").when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(v).isin("[]", "{}"))
    return F.coalesce(true.when(kind == "VOID", F.lit(False)).otherwise(number), F.lit(False))


def test_description(response: Column) -> Column:
    """struct(purpose, scenario, expected_behavior): of a JSON object, else the text as purpose alone."""
    v = F.try_parse_json(response)
    fields = ("purpose", "scenario", "expected_behavior")
    return F.when(v.isNull(), F.struct(response.alias("purpose"), F.lit("").alias("scenario"), F.lit("").alias("expected_behavior"))).otherwise(F.struct(*(F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in fields)))


def unnested(v: Column) -> Column:
    """A variant whose string holds JSON, decoded; other values as they are."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)


def synthetic_id(owner: Column, name: Column, original: Column, at: Column) -> Column:
    """``<owner>__<name>-`` and what follows the last ``__`` of the original id, else a time as 14 digits."""
    tail = F.coalesce(F.substring_index(original, "__", -1), F.date_format(at, "yyyyMMddHHmmss"))
    return F.concat(owner, F.lit("__"), name, F.lit("-"), tail)


def asks_confirmation(action: Column, mode: Column, whitelist: tuple[str, ...] = ()) -> Column:
    """In confirm mode, whether no pattern of the whitelist matches at the action's start."""
    known = action.rlike("^(?:" + "|".join(f"(?:{p})" for p in whitelist) + ")") if whitelist else F.lit(False)
    return (mode == "confirm") & ~known
