"""Registered queries on the text functions, coverage and validation, over rows built from the tables; their SQL says the rules anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import scopes, skills
from runlens.plans.registry import long, query, table

_SOME = "concat('d', doc_id % 9)"
_PATH = f"""CASE doc_id % 8 WHEN 0 THEN concat('/testbed/src/', {_SOME}, '.py') WHEN 1 THEN concat('./a/tests/', {_SOME}, '.ts') WHEN 2 THEN '/testbed' WHEN 3 THEN concat('src/', {_SOME}, '_test.go')
WHEN 4 THEN concat('//x/', {_SOME}, '.spec.js') WHEN 5 THEN concat('repo/test_', {_SOME}, '.md') WHEN 6 THEN concat('/testbed./lib/', {_SOME}, '.tsx') ELSE concat('lib/contest_', {_SOME}, '.jsx') END"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(rf"""SELECT doc_id, n AS path, regexp_matches(n, '\.(py|go|ts|tsx|js|jsx)$') AS source, regexp_matches('/' || n, '/tests?/|__tests__/|\.(test|spec)\.|_test\.(go|py)$|/test_[^/]*$') AS test,
CASE WHEN starts_with(p, '/testbed/') THEN substr(p, 10) ELSE regexp_replace(p, '^repo/', '') END AS relative
FROM (SELECT doc_id, p, ltrim(CASE WHEN starts_with(p, '/testbed') THEN substr(p, 9) WHEN starts_with(p, './') THEN substr(p, 3) ELSE p END, '/') AS n FROM (SELECT doc_id, {_PATH} AS p FROM documents))""")
def path_rules(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.expr(_PATH).alias("p"))
    n = text.normalise_path(F.col("p"))
    return d.select("doc_id", n.alias("path"), text.is_source_file(n).alias("source"), text.is_test_file(n).alias("test"), text.relative_path(F.col("p"), F.lit("/testbed")).alias("relative"))


_TEST_ID = "CASE doc_id % 3 WHEN 0 THEN concat('a/b.py::', source, '::x', doc_id) WHEN 1 THEN concat('Test', doc_id) ELSE concat('c.py::', lang) END"
_REMOTE = "CASE doc_id % 3 WHEN 0 THEN concat('git@host:', source, '/', lang, '.git') WHEN 1 THEN concat('https://host/', source, '/', lang) ELSE concat('https://host/', source, '/', lang, '.x.git/') END"


@query(f"""SELECT doc_id, translate(replace(t, '::', '__'), '/.', '__') AS slug, CASE WHEN contains(t, '::') THEN split_part(t, '::', 1) ELSE '.' END AS path, CASE WHEN contains(t, '::') THEN substr(t, instr(t, '::') + 2) ELSE t END AS name,
source || '/' || lang || CASE WHEN doc_id % 3 = 2 THEN '.x' ELSE '' END AS repo, CASE WHEN doc_id % 4 = 0 THEN 'own/' || doc_id WHEN doc_id % 4 = 1 THEN 'img' ELSE 'docker.io/swebench/sweb.eval.x86_64.' || lower(source || '_1776_' || lang) || ':latest' END AS image
FROM (SELECT *, {_TEST_ID} AS t FROM documents)""")
def name_rules(spark, sf_dir):
    t, i = F.expr(_TEST_ID), F.col("doc_id")
    image = text.image_name(F.when(i % 4 == 0, F.concat(F.lit("own/"), i.cast("string"))).otherwise(""), F.when(i % 4 == 1, "img"), F.concat("source", F.lit("__"), "lang"))
    return _docs(spark, sf_dir).select("doc_id", text.test_slug(t).alias("slug"), text.split_test_id(t).alias("s"), text.repo_slug(F.expr(_REMOTE)).alias("repo"), image.alias("image")).select("doc_id", "slug", "s.path", "s.name", "repo", "image")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN concat_ws(' | ', 'Symptom: ' || lang, CASE WHEN doc_id % 3 <> 0 THEN 'Expect: ' || source END, CASE WHEN doc_id % 2 = 0 THEN 'Constraints: ' || n_chars END) END AS focus FROM documents""")
def focus_format(spark, sf_dir):
    i = F.col("doc_id")
    return _docs(spark, sf_dir).select("doc_id", text.format_focus(F.when(i % 5 != 0, F.col("lang")).otherwise(""), F.when(i % 3 != 0, F.col("source")), F.when(i % 2 == 0, F.col("n_chars").cast("string")).otherwise("")).alias("focus"))


@query("""WITH l AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS p FROM documents)
SELECT doc_id, sha256(array_to_string(p[-3:], chr(10))) AS tail, CASE WHEN length(text) > 20 THEN left(text, 17) || '...' ELSE rpad(text, 20, ' ') END AS head, CASE WHEN length(text) > 20 THEN '...' || right(text, 17) ELSE rpad(text, 20, ' ') END AS back FROM l""".replace("\\\\", "\\"))
def output_cuts(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.tail_lines(t, 3).cast("binary"), 256).alias("tail"), text.shorten(t, 20).alias("head"), text.shorten(t, 20, left=True).alias("back"))


_CODE = "CASE doc_id % 4 WHEN 0 THEN concat('see ```python\n f(', source, '[1\n``` x') WHEN 1 THEN concat('g({a if ', lang, '  ') WHEN 2 THEN concat('h(a if b else ', lang, '}') ELSE concat('```\n', lang, ')\n``` and ```z```') END"


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'f(' || source || '[1' || ')]' WHEN 1 THEN 'g({{a if ' || lang || ' else None' || ')}}' WHEN 2 THEN 'h(a if b else ' || lang || '}})' ELSE lang || ')' END AS code,
{" AND ".join(f"abs(length(replace(t, '{a}', '')) - length(replace(t, '{b}', ''))) <= 2" for a, b in ("()", "[]", ("{", "}")))} AS balanced FROM (SELECT *, {_CODE} || repeat('(', doc_id % 6) AS t FROM documents)""")
def code_fixes(spark, sf_dir):
    c = F.expr(_CODE.replace("\n", "\\n"))
    return _docs(spark, sf_dir).select("doc_id", text.code_block(c).alias("code"), text.delimiters_balanced(F.concat(c, F.repeat(F.lit("("), F.col("doc_id") % 6))).alias("balanced"))


_LISTING = "concat(source, '.py::a[1]\n  ', source, '.py::a[2]\n= x.py::no\nno tests ran.py::\n', lang, '.py::T::b\n', doc_id, ' items')"


@query(f"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: contains(x, '.py::') AND NOT regexp_matches(x, '^(=|-|no tests|<)')), lambda x: split_part(x, '[', 1)), ',') AS all_tests,
source || '.py::a,' || lang || '.py::T::b' AS tests FROM (SELECT *, {_LISTING} AS t FROM documents)""")
def test_listing(spark, sf_dir):
    c = F.expr(_LISTING.replace("\n", "\\n"))
    once = text.listed_tests(c)
    first = F.concat_ws(",", F.get(once, F.lit(0)), once)  # the listing names its first test twice, by parameter
    return _docs(spark, sf_dir).select("doc_id", first.alias("all_tests"), F.array_join(once, ",").alias("tests"))


_SAID = "CASE doc_id % 4 WHEN 0 THEN concat(lang, ' \n```bash\nls ', source, '\n```\n', n_chars) WHEN 1 THEN concat(lang, ' ```bash open ', source, ' ') WHEN 2 THEN concat(' none ', source) ELSE concat('```bash\na\n```\n', lang, '```bash\nb\n```') END"


@query(f"""WITH m AS (SELECT doc_id, m, instr(m, '```bash') AS o, regexp_extract_all(m, '(?s)```bash\\s*\\n(.*?)\\n```', 1) AS f FROM (SELECT doc_id, {_SAID} AS m FROM documents))
SELECT doc_id, CASE WHEN o = 0 THEN m ELSE trim(left(m, o - 1), ' ' || chr(10)) END AS thought, CASE WHEN o = 0 THEN '' ELSE trim(split_part(substr(m, o + 7), '```', 1), ' ' || chr(10)) END AS action,
CASE WHEN len(f) = 1 THEN trim(f[1], ' ' || chr(10)) END AS strict_action, CASE WHEN len(f) <> 1 THEN 'FormatError: ' || len(f) END AS error FROM m""".replace("\\\\", "\\"))
def messages_parsed(spark, sf_dir):
    c = F.expr(_SAID.replace("\n", "\\n"))
    return _docs(spark, sf_dir).select("doc_id", text.parse_message(c).alias("m"), text.parse_action(c).alias("a")).select("doc_id", "m.thought", "m.action", F.col("a.action").alias("strict_action"), "a.error")


_DIFF = "concat('diff --git a/', source, '.py b/', lang, '.py\n+x\ndiff --git a/q b/r.go extra\n diff --git a/no b/no\ncat /testbed/', source, '.ts ./', lang, '/m.js conf.jsonx')"


@query("""SELECT doc_id, lang || '.py,r.go' AS files, 'a/' || source || '.py,b/' || lang || '.py,b/r.go,' || source || '.ts,' || lang || '/m.js,conf.js' AS mentions FROM documents""")
def diff_mentions(spark, sf_dir):
    c = F.expr(_DIFF.replace("\n", "\\n"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.diff_files(c), ",").alias("files"), F.array_join(text.path_mentions(c), ",").alias("mentions"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 4) THEN 'Submitted' ELSE 'continue' END AS state FROM documents""")
def submissions(spark, sf_dir):
    i, body = F.col("doc_id") % 6, F.col("source")
    out = lambda first, rest: F.concat(F.lit(f" \n{first} \n"), rest)
    shown = F.when(i == 0, out(text.SUBMIT, body)).when(i == 1, out(text.SUBMIT, F.lit(" \n"))).when(i == 2, out(text.SUBMIT, F.concat(F.lit("error: "), body))).when(i == 3, F.concat(body, F.lit(f"\n{text.SUBMIT}\nx")))
    return _docs(spark, sf_dir).select("doc_id", text.submission_state(shown.when(i == 4, out(text.SUBMIT_LEGACY, F.lit(""))).otherwise(out(text.SUBMIT_LEGACY, F.lit("fatal: x")))).alias("state"))


_EV = "(SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"


@query(f"""SELECT DISTINCT 'pkg/f' || (k % 5) || '.go' AS file, unnest(range(k, k + event_id % 4))::INTEGER AS line FROM {_EV} WHERE event_id % 3 > 0 AND k % 7 > 0""")
def coverage_go_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    row = "concat('mod/pkg/f', k % 5, if(k % 7 = 0, '_test', ''), '.go:', k, '.1,', k + event_id % 4 - 1, '.9 2 ', event_id % 3)"
    return scopes.go_coverage(e.select(F.expr(row).alias("value")), "mod")


@query("""SELECT DISTINCT source || '/' || lang || '.py' AS file, unnest([doc_id % 40, doc_id % 11 + 1])::INTEGER AS line FROM documents WHERE doc_id % 3 > 0""")
def coverage_python_rows(spark, sf_dir):
    row = "concat('{\"files\": {\"', source, '/', if(doc_id % 3 = 0, 'test_', ''), lang, '.py\": {\"executed_lines\": [', doc_id % 40, ', ', doc_id % 11 + 1, ']}}}')"
    return scopes.python_coverage(_docs(spark, sf_dir).select(F.expr(row).alias("value")))


_RESPONSE = """concat('[{"api_path": "', if(doc_id % 3 = 0, lang, 'a.py'), '", "purpose": ', if(doc_id % 5 = 0, '1', '""'), ', "experience_or_reflection": "e"', if(doc_id % 7 = 0, '', ', "thinking": "t"'), ', "related_apis": ', if(doc_id % 4 = 0, '["a.py", "en"]', '[]'), '}]')"""


@query("""SELECT doc_id, CASE WHEN (doc_id % 3 > 0 OR lang = 'en') AND doc_id % 7 > 0 THEN 1::BIGINT END AS n_local, CASE WHEN (doc_id % 3 > 0 OR lang = 'en') AND doc_id % 5 > 0 THEN CASE WHEN doc_id % 4 = 0 THEN 2::BIGINT ELSE 0 END END AS n_related FROM documents""")
def validated_rows(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.expr(_RESPONSE).alias("response"), F.array(F.lit("a.py"), F.lit("en")).alias("candidates"))
    local = skills.valid_local(d).select("doc_id", long(F.size("items")).alias("n_local"))
    return local.join(skills.valid_global(d).select("doc_id", long(F.size(F.get("items", F.lit(0))["related_apis"])).alias("n_related")), "doc_id")
