"""Opaque computations on source text: parsing, scopes, splicing and diffs, as Arrow-batched functions."""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

SCOPES = "filepath string, class_name string, function_name string, start_line int, end_line int, docstring string, ord int"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def python_scopes(source: str) -> list[tuple]:
    """(class, function, start, end, docstring) of top-level classes, their own methods and top-level functions.

    Text that doesn't parse has none; of equal names the last stands.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    found: dict[tuple, tuple] = {}

    def add(cls, fn, node):
        found.pop((cls, fn), None)
        found[cls, fn] = (node.lineno, node.end_lineno, ast.get_docstring(node))

    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            for key in [k for k in found if k[0] == node.name]:
                del found[key]
            add(node.name, None, node)
            for inner in node.body:
                if isinstance(inner, _DEFS):
                    add(node.name, inner.name, inner)
        elif isinstance(node, _DEFS):
            add(None, node.name, node)
    return [(*k, *v) for k, v in found.items()]


_NAME = r"[A-Za-z_$][\w$]*"
# The forms of a function in brace languages, named function, arrow function, method and Go function.
_NAMED = rf"(?:export\s+)?(?:async\s+)?function\s+(?P<named>{_NAME})\s*\([^)]*\)\s*\{{"
_ARROW = rf"(?P<arrow>{_NAME})\s*[:=]\s*(?:async\s*)?\([^)]*\)\s*=>\s*\{{"
_METHOD = rf"(?P<method>{_NAME})\s*\([^)]*\)\s*\{{"
_GO = r"func\s+(?:\([^)]*\)\s*)?(?P<go>[A-Za-z_]\w*)\s*\([^)]*\)[^{]*\{"
_FUNCTIONS = re.compile(f"{_NAMED}|{_ARROW}|{_GO}")
_BY_LANGUAGE = {"go": re.compile(_GO), "script": re.compile(f"{_NAMED}|{_ARROW}|{_METHOD}")}
#: A quoted string (to the end of text where it isn't closed) or a brace.
_QUOTED_OR_BRACE = re.compile(r"""(["'`])(?:\\.?|(?!\1)[^\\])*+(?:\1|\Z)|[{}]""", re.S)


def _brace_functions(source: str, forms: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """(name, first line, last line) of what ``forms`` match, each to the brace that closes its first one, else to the end."""
    line = lambda at: source.count("\n", 0, at) + 1
    for m in forms.finditer(source):
        level, end = 0, len(source) - 1
        for token in _QUOTED_OR_BRACE.finditer(source, m.end() - 1):
            level += {"{": 1, "}": -1}.get(token[0], 0)
            if not level and token[0] == "}":
                end = token.start()
                break
        yield m[m.lastgroup], line(m.start()), line(end)


def brace_scopes(source: str) -> list[tuple]:
    """Functions of brace languages; of equal names the last stands, at the place of the first."""
    ends = {name: (start, end) for name, start, end in _brace_functions(source, _FUNCTIONS)}
    return [(None, name, start, end, None) for name, (start, end) in ends.items()]


def all_functions(path: str, source: str) -> list[tuple]:
    """(name, start, end, has docstring) of every function, nested ones too: of Python by level, else in order.

    In scripts any ``name(..) {`` counts, conditions and loops included.
    """
    if path.endswith(".py"):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        return [(n.name, n.lineno, n.end_lineno, bool(ast.get_docstring(n))) for n in ast.walk(tree) if isinstance(n, _DEFS)]
    return [(*found, False) for found in _brace_functions(source, _BY_LANGUAGE["go" if path.endswith(".go") else "script"])]


def functions(files: DataFrame) -> DataFrame:
    """(filepath, ord, name, start_line, end_line, has_docstring) of every function in (filepath, content) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, i, *f) for path, text in zip(pdf["filepath"], pdf["content"], strict=True) for i, f in enumerate(all_functions(path or "", text or ""))]
            yield pd.DataFrame(rows, columns=["filepath", "ord", "name", "start_line", "end_line", "has_docstring"])

    return files.select("filepath", "content").mapInPandas(run, "filepath string, ord int, name string, start_line int, end_line int, has_docstring boolean")


def scopes(files: DataFrame) -> DataFrame:
    """The scope table of (filepath, content) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (path, *scope, i)
                for path, text in zip(pdf["filepath"], pdf["content"], strict=True)
                for i, scope in enumerate((python_scopes if str(path).endswith(".py") else brace_scopes)(text or ""))
            ]
            yield pd.DataFrame(rows, columns=["filepath", "class_name", "function_name", "start_line", "end_line", "docstring", "ord"])

    return files.select("filepath", "content").mapInPandas(run, SCOPES)


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series, path: pd.Series) -> pd.Series:
    """A git-style unified diff of two texts."""
    return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{p}", f"b/{p}")) for a, b, p in zip(old, new, path, strict=True)])


@F.pandas_udf(BooleanType())
def parses(source: pd.Series) -> pd.Series:
    def ok(text):
        try:
            ast.parse(text or "")
            return True
        except (SyntaxError, ValueError):
            return False

    return source.map(ok)


@F.pandas_udf(StringType())
def reindent(code: pd.Series, base: pd.Series) -> pd.Series:
    """Code shifted so that its least indent is ``base`` characters, tabs counted as one; blank lines stay, bare; nothing becomes ``pass``."""

    def one(text, n):
        rows = (text or "").split("\n")
        indents = [len(r) - len(r.lstrip()) for r in rows]
        least = min((i for i, r in zip(indents, rows, strict=True) if r.strip()), default=None)
        if least is None:
            return " " * int(n) + "pass"
        return "\n".join(" " * max(0, i + int(n) - least) + r.lstrip() if r.strip() else "" for i, r in zip(indents, rows, strict=True))

    return pd.Series([one(t, n) for t, n in zip(code, base, strict=True)])


def splice(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Files with their edits (filepath, start_line, end_line, code) put in, from the bottom up."""
    held = edits.groupBy("filepath").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "code")), asc=False).alias("edits"))
    lines = F.split("content", "\n")
    put = F.aggregate(
        "edits",
        lines,
        lambda acc, e: F.concat(F.slice(acc, F.lit(1), e["start_line"] - 1), F.split(e["code"], "\n"), F.slice(acc, e["end_line"] + 1, F.greatest(F.size(acc) - e["end_line"], F.lit(0)))),
    )
    return files.join(held, "filepath").select("filepath", "content", F.array_join(put, "\n").alias("edited"))
