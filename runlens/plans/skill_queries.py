"""Registered queries on skills, prompts, segments and calls, with DuckDB SQL computed from the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import code, text
from runlens.operators import prompts, runs, scopes, segments, skills
from runlens.plans.registry import long, query, table

_EV = "(SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("""WITH i AS (SELECT source, doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'f' || doc_id || '.py' ELSE '' END AS api_path, CASE WHEN doc_id % 11 <> 0 THEN lang END AS purpose,
CASE WHEN doc_id % 2 = 0 THEN '  ' || source || ' ' ELSE ' ' END AS playbook, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
s AS (SELECT source, string_agg('- ' || api_path || ': ' || purpose || CASE WHEN trim(playbook) <> '' THEN chr(10) || '  - playbook: ' || trim(playbook) ELSE '' END, chr(10) ORDER BY r) AS l
FROM i WHERE r <= 5 AND api_path <> '' AND purpose IS NOT NULL GROUP BY source)
SELECT source, 'Task of ' || source || chr(10) || chr(10) || '=== Global Diagnostic Skills ===' || coalesce(chr(10) || l, '') AS text FROM (SELECT DISTINCT source FROM documents) LEFT JOIN s USING (source)""")
def skill_render_global(spark, sf_dir):
    d, i = _docs(spark, sf_dir), F.col("doc_id")
    items = d.select(
        "source",
        F.col("doc_id"),
        (-F.col("n_chars")).alias("o"),
        F.when(i % 7 != 0, F.concat(F.lit("f"), i.cast("string"), F.lit(".py"))).otherwise("").alias("api_path"),
        F.when(i % 11 != 0, F.col("lang")).alias("purpose"),
        F.when(i % 2 == 0, F.concat(F.lit("  "), "source", F.lit(" "))).otherwise(" ").alias("playbook"),
    )
    tasks = d.select("source", F.concat(F.lit("Task of "), "source").alias("task")).distinct()
    return prompts.global_skills(tasks, items, "source", ["o", "doc_id"])


@query(f"""WITH i AS (SELECT user_id, 'f' || (k % 10) || '.py::g' AS api_path, event_id, CASE WHEN event_type = 'view' THEN '  ' ELSE event_type || ' ' END AS x, CASE WHEN value > 50 THEN ' big ' END AS issue FROM {_EV}),
p AS (SELECT user_id, api_path, coalesce(string_agg(CASE WHEN trim(x) <> '' THEN '- ' || CASE WHEN issue IS NOT NULL THEN '[big] ' ELSE '' END || trim(x) || chr(10) END, '' ORDER BY event_id), '') AS l FROM i GROUP BY ALL)
SELECT user_id, sha256(rtrim('=== Local Intervention Skills ===' || chr(10) || string_agg('API: ' || api_path || chr(10) || l, chr(10) ORDER BY api_path), chr(10))) AS digest FROM p GROUP BY user_id""")
def skill_render_local(spark, sf_dir):
    e = _events(spark, sf_dir)
    fired = e.select(
        "user_id",
        F.concat(F.lit("f"), (F.col("k") % 10).cast("string"), F.lit(".py::g")).alias("api_path"),
        "event_id",
        F.when(F.col("event_type") == "view", "  ").otherwise(F.concat("event_type", F.lit(" "))).alias("experience_or_reflection"),
        F.when(F.col("value") > 50, " big ").alias("issue"),
    )
    return prompts.local_skills(fired, ["user_id"], ["event_id"]).select("user_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


_KIND = "CASE quality WHEN 1 THEN 'success_experience' WHEN 0 THEN 'failure_reflection' ELSE '' END"


@query(f"""SELECT doc_id, 'You can refer to these domain-specific knowledge to fix this task:' || chr(10) || CASE {_KIND}
WHEN 'success_experience' THEN chr(10) || 'Strategies that worked for similar issues:' || chr(10) || '  1. ' || source || chr(10) || '  2. ' || lang
WHEN 'failure_reflection' THEN chr(10) || '  - ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '    Suggested resources: ' || lang ELSE '' END || chr(10) || 'Correct approach: ' || n_chars ELSE '' END AS text
FROM documents LEFT JOIN labels USING (doc_id)""")
def experience_legacy(spark, sf_dir):
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    missing = F.array(F.struct(F.col("source").alias("description"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("suggested_resources")))
    return d.select("doc_id", prompts.experience_text(F.expr(_KIND), F.array("source", "lang"), missing, F.col("n_chars").cast("string")).alias("text"))


_PROMPT = r"""SELECT doc_id, sha256(concat_ws(chr(10), '=== Instance ===', 'instance_id: ' || source, 'resolved: ' || (quality = 1)::VARCHAR, '', '=== Problem Statement ===', text, '', '=== Candidate Patch ===', lang, '',
CASE WHEN quality = 0 THEN concat_ws(chr(10), '=== Golden Patch (unresolved only) ===', 'gold', '', '=== Golden Tests (unresolved only) ===', '', '') END,
'=== Agent Trajectory ===', n_chars, '', '=== Candidate API Paths (STRICT) ===', '- a.py', '- ' || source, '', '=== Task ===', %s, 'Output top 10 items.')) AS digest FROM documents JOIN labels USING (doc_id)"""


def _prompt(spark, sf_dir, form):
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    built = prompts.skills_prompt(form, F.col("source"), F.col("quality") == 1, F.col("text"), F.col("lang"), F.lit("gold"), F.lit(None).cast("string"), F.col("n_chars").cast("string"), F.array(F.lit("a.py"), F.col("source")))
    return d.select("doc_id", F.sha2(built.cast("binary"), 256).alias("digest"))


@query(_PROMPT % "'Return a JSON ARRAY only. Each item: api_path, experience_or_reflection, thinking.', 'api_path MUST be from Candidate API Paths.'")
def prompt_local(spark, sf_dir):
    return _prompt(spark, sf_dir, "local")


@query(
    _PROMPT
    % """'Return a JSON ARRAY only. Each item: api_path, purpose, playbook, related_apis, thinking.', 'api_path and related_apis MUST be from Candidate API Paths.', 'related_apis: array of {"api_path": "...", "reason": "..."} objects.'"""
)
def prompt_global(spark, sf_dir):
    return _prompt(spark, sf_dir, "global")


@query("""SELECT item_id, concat_ws(chr(10), 'Summarize the issue into a structured JSON object.', 'Use the golden patch and tests to identify the root requirement.', '', '<problem_statement>',
left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1200), '</problem_statement>', '', '<test_cases_or_test_patch>', '', '</test_cases_or_test_patch>', '', '<golden_patch>', item_id, '</golden_patch>', '', 'Return ONLY a JSON object.') AS prompt
FROM benchmark""".replace("\\\\", "\\"))
def prompt_issue(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", prompts.issue_prompt(F.col("text"), F.lit(None).cast("string"), F.col("item_id").cast("string")).alias("prompt"))


@query("""SELECT conv_id, turn, CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN CASE WHEN role = 'tool' THEN 'entry' ELSE 'content' END END AS cache_mark FROM conversations""")
def cache_marks(spark, sf_dir):
    return prompts.mark_last(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn").drop("role")


_ITEM = """SELECT doc_id, CASE WHEN lang = 'en' THEN source WHEN lang = 'fr' THEN '' END AS record_id, CASE WHEN doc_id % 3 = 0 THEN 'i' || doc_id END AS instance_id, CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id END AS source_instance_id FROM documents"""


@query(f"""SELECT l.doc_id AS doc_id, coalesce(instance_id, nullif(record_id, ''), source_instance_id) AS instance_id, coalesce(source_instance_id, nullif(record_id, '')) AS source_instance_id FROM ({_ITEM}) l""")
def source_ids(spark, sf_dir):
    i = F.col("doc_id")
    items = _docs(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "fr", "").alias("record_id"),
        F.when(i % 3 == 0, F.concat(F.lit("i"), i.cast("string"))).alias("instance_id"),
        F.when(i % 2 == 0, F.concat(F.lit("s"), i.cast("string"))).alias("source_instance_id"),
    )
    local = skills.with_source_ids(items, local=True).select("doc_id", "instance_id")
    return local.join(skills.with_source_ids(items, local=False).select("doc_id", "source_instance_id"), "doc_id")


@query("""SELECT doc_id AS item, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def publish_skills(spark, sf_dir):
    items = _docs(spark, sf_dir).select(F.col("doc_id").alias("item"), "lang", F.col("doc_id").cast("string").alias("instance_id"), F.col("source").alias("source_instance_id"))
    chosen = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("instance_id"))
    return skills.published(items, chosen)


@query("""SELECT doc_id, coalesce(lang IN ('en', 'fr'), false) AS synthesized, NOT (lang LIKE 'e%' OR lang LIKE '_e%') AS asks FROM documents WHERE contains(source, '1')""")
def row_predicates(spark, sf_dir):
    d = runs.containing(_docs(spark, sf_dir), "1", "source")
    kind = F.when(F.col("lang") == "en", "synthesized_experience").when(F.col("lang") == "fr", "domain2").otherwise(F.col("lang"))
    return d.select("doc_id", skills.is_synthesized(kind).alias("synthesized"), text.asks_confirmation(F.col("lang"), F.lit("confirm"), ("e", ".e")).alias("asks"))


@query("""SELECT doc_id, quality, source FROM labels JOIN documents USING (doc_id)""")
def golden_join(spark, sf_dir):
    return skills.with_golden(table(spark, sf_dir, "labels"), _docs(spark, sf_dir).select("doc_id", "source"), "doc_id").select("doc_id", "quality", "source")


_SEGMENTS = f"""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k) AS ord, k AS start_line, n AS line_count FROM (SELECT user_id, k, count(*) AS n FROM {_EV} GROUP BY ALL)),
r AS (SELECT user_id, event_id AS pos, k % 200 AS segment_id, event_type AS reason, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {_EV})"""


def _segments(spark, sf_dir):
    from pyspark.sql import Window

    e = _events(spark, sf_dir)
    s = e.groupBy("user_id", F.col("k").alias("start_line")).agg(F.count("*").alias("line_count"))
    return e, s.withColumn("ord", long(F.row_number().over(Window.partitionBy("user_id").orderBy("start_line"))))


@query(_SEGMENTS + "SELECT user_id, pos, reason, start_line FROM r JOIN s ON r.user_id = s.user_id AND segment_id = ord WHERE i <= 5".replace("SELECT user_id", "SELECT r.user_id AS user_id"))
def segments_ranked(spark, sf_dir):
    e, s = _segments(spark, sf_dir)
    ranks = e.select("user_id", F.col("event_id").alias("pos"), (F.col("k") % 200).alias("segment_id"), F.col("event_type").alias("reason"))
    return segments.ranked_segments(ranks, s, ["user_id"]).select("user_id", "pos", "reason", "start_line")


@query(_SEGMENTS + "SELECT * FROM (SELECT user_id, ord, line_count, row_number() OVER (PARTITION BY user_id ORDER BY line_count DESC, ord) AS rank FROM s) WHERE rank <= 5")
def segments_longest(spark, sf_dir):
    _, s = _segments(spark, sf_dir)
    return segments.longest_segments(s, ["user_id"]).select("user_id", "ord", "line_count", long("rank").alias("rank"))


@query(f"""SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(bugs, 0) AS bugs_count, coalesce(files, '') AS files_modified, coalesce(attempts, 0) AS total_attempts
FROM (SELECT user_id, count(*) AS attempts FROM events WHERE event_type <> 'view' GROUP BY user_id) a
FULL JOIN (SELECT user_id, count(*) AS bugs, string_agg(DISTINCT 'f' || (k % 10), ',' ORDER BY 'f' || (k % 10)) AS files FROM {_EV} WHERE event_type = 'click' GROUP BY user_id) b ON a.user_id = b.user_id""")
def segment_totals(spark, sf_dir):
    e = _events(spark, sf_dir)
    bugs = e.filter("event_type = 'click'").select("user_id", F.concat(F.lit("f"), (F.col("k") % 10).cast("string")).alias("filepath"))
    return segments.segment_totals(bugs, e.filter("event_type <> 'view'"), ["user_id"]).withColumn("files_modified", F.array_join("files_modified", ","))


_PATH = "CASE k % 7 WHEN 0 THEN '/repo/lib/site-packages/a.py' WHEN 1 THEN '/repo/__pycache__/a.py' WHEN 2 THEN '/elsewhere/a.py' WHEN 3 THEN '/repo/tests/a.py' WHEN 4 THEN '/repo/a.pyc' ELSE concat('/repo/f', k % 9, '.py') END"


@query(f"""WITH c AS (SELECT user_id, substr(p, 7) || '::' || event_type AS call FROM (SELECT user_id, event_type, {_PATH} AS p FROM {_EV}) WHERE p LIKE '/repo/f%')
SELECT user_id, call, n, (sum(n) OVER (PARTITION BY user_id))::BIGINT AS total FROM (SELECT user_id, call, count(*) AS n FROM c GROUP BY ALL)""")
def trace_calls(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("p", F.expr(_PATH)).filter(segments.traced(F.col("p"), "/repo", ("/usr/lib/python3",)))
    return segments.call_counts(e.select("user_id", F.substr("p", F.lit(7)).alias("path"), F.col("event_type").alias("function")), ["user_id"])


@query(r"""SELECT DISTINCT user_id AS doc_id, (k % 5)::INTEGER AS line, rtrim(l[k % 5]) AS code FROM (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events) JOIN
(SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents) d ON user_id = d.doc_id WHERE k % 5 BETWEEN 1 AND len(l)""")
def line_text(spark, sf_dir):
    asked = _events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), (F.col("k") % 5).alias("line"))
    return segments.line_texts(asked, _docs(spark, sf_dir).select("doc_id", F.col("text").alias("content")), "doc_id")


@query("""WITH d AS (SELECT doc_id, 1 + doc_id % 3 AS s, 2 + doc_id % 3 AS e, string_split(text, chr(10)) AS p FROM documents),
f AS (SELECT doc_id, s, e, [x FOR x IN [p[i] || CASE WHEN i < len(p) THEN chr(10) ELSE '' END FOR i IN range(1, len(p) + 1)] IF x <> ''] AS l FROM d)
SELECT doc_id, s AS start_line, e AS end_line, sha256(rtrim(array_to_string(l[s:e], ''), chr(10))) AS code, sha256(array_to_string(CASE WHEN s > 1 THEN l[greatest(1, s - 2):s - 1] ELSE [] END, '')) AS before,
sha256(array_to_string(l[e + 1:e + 2], '')) AS after, coalesce(length(l[s]) - length(ltrim(l[s], ' ' || chr(9) || chr(10))), 0) AS base_indent FROM f""")
def segment_context(spark, sf_dir):
    d = _docs(spark, sf_dir)
    files = d.select("doc_id", F.col("text").alias("content"))
    parts = d.select("doc_id", (1 + F.col("doc_id") % 3).alias("start_line"), (2 + F.col("doc_id") % 3).alias("end_line"))
    out = segments.with_context(parts, files, "doc_id", 2)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "start_line", "end_line", digest("code").alias("code"), digest("context_before").alias("before"), digest("context_after").alias("after"), long("base_indent").alias("base_indent"))


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL""")
def ordered_dedup(spark, sf_dir):
    return segments.ordered_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


_ACCESSED = "concat(CASE WHEN k % 4 = 0 THEN 'tests/' ELSE 'src/' END, 'f', k % 10, CASE WHEN k % 5 = 0 THEN '.md' ELSE '.py' END)"
_EXTRA = "concat(CASE WHEN doc_id % 3 = 0 THEN 'src/f' ELSE 'src/test_f' END, doc_id % 20, '.py')"


@query(f"""WITH a AS (SELECT user_id, f, CASE WHEN event_type = 'click' THEN f || '::' || event_type ELSE f END AS scope_key FROM (SELECT user_id, event_type, {_ACCESSED} AS f FROM {_EV}) WHERE f LIKE 'src/%.py'),
x AS (SELECT DISTINCT doc_id % 50 AS user_id, {_EXTRA} AS scope_key FROM labels WHERE doc_id % 3 = 0)
SELECT user_id, scope_key, sum(n)::BIGINT AS count FROM (SELECT user_id, scope_key, 1 AS n FROM a UNION ALL SELECT user_id, scope_key, 0 FROM x) GROUP BY ALL""")
def access_counts(spark, sf_dir):
    e, x = _accessed(spark, sf_dir)
    key = F.when(F.col("event_type") == "click", F.concat("filepath", F.lit("::"), "event_type")).otherwise(F.col("filepath"))
    return scopes.access_counts(e.withColumn("scope_key", key), x, "user_id")


def _accessed(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_type", F.expr(_ACCESSED).alias("filepath"))
    return e, table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("user_id"), F.expr(_EXTRA).alias("filepath"))


@query(f"""SELECT user_id, f AS filepath FROM (SELECT user_id, {_ACCESSED} AS f FROM {_EV}) WHERE f LIKE 'src/%.py' UNION SELECT doc_id % 50, {_EXTRA} FROM labels WHERE doc_id % 3 = 0""")
def candidate_files(spark, sf_dir):
    e, x = _accessed(spark, sf_dir)
    return scopes.candidate_files(e, x, "user_id")


_FILE = "concat(source, '/', CASE doc_id % 4 WHEN 0 THEN concat('p', doc_id % 50, '_test.go') WHEN 1 THEN concat('q', doc_id % 50, '.spec.ts') WHEN 2 THEN concat('node_modules/q', doc_id % 50, '.test.js') ELSE concat('r', doc_id, '.go') END)"


@query(f"""WITH d AS (SELECT doc_id, source, lang, {_FILE} AS f FROM documents)
SELECT DISTINCT './' || source || '::Test' || lang AS test_id FROM d WHERE f LIKE '%\\_test.go' ESCAPE '\\' UNION SELECT DISTINCT f || '::works in ' || lang FROM d WHERE f LIKE '%.spec.ts'""".replace("\\\\", "\\"))
def test_discovery(spark, sf_dir):
    body = F.concat(F.lit("func Test"), "lang", F.lit("(t *testing.T) {\n}\n  func TestInner(\n  it('works in "), "lang", F.lit("', () => {"))
    return segments.test_names(_docs(spark, sf_dir).select(F.expr(_FILE).alias("filepath"), body.alias("content"))).select("test_id")


_REPLY = """CASE doc_id % 5 WHEN 0 THEN concat('x ```json\n[{"segment_id": ', doc_id, '}]\n``` [1, 2]') WHEN 1 THEN concat('see [{"segment_id": ', doc_id, '}, {"segment_id": 2}] ok') WHEN 2 THEN 'none' WHEN 3 THEN concat('```json\n{"a": 1}\n``` [{"segment_id": ', doc_id, '}]') ELSE '] [' END"""


@query(f"""SELECT doc_id, CASE WHEN json_valid(f) THEN CASE json_type(f) WHEN 'ARRAY' THEN n(f) ELSE n(s) END ELSE n(s) END AS n, CASE WHEN doc_id % 5 IN (0, 1, 3) THEN doc_id END AS first FROM
(SELECT doc_id, regexp_extract(r, '(?s)```json\\s*(.*?)\\s*```', 1) AS f, regexp_extract(r, '(?s)\\[.*\\]') AS s FROM (SELECT doc_id, {_REPLY} AS r FROM documents))""".replace("\\\\", "\\").replace("n(f)", "json_array_length(f)::BIGINT").replace("n(s)", "(CASE WHEN json_valid(s) THEN json_array_length(s) ELSE 0 END)::BIGINT"))
def parse_rankings(spark, sf_dir):
    found = text.rankings(F.expr(_REPLY.replace("\n", "\\n")))
    return _docs(spark, sf_dir).select("doc_id", long(F.size(found)).alias("n"), F.try_variant_get(F.get(found, F.lit(0)), "$.segment_id", "bigint").alias("first"))


_JUDGE = """CASE doc_id % 8 WHEN 0 THEN 'so {"resolved": true} end' WHEN 1 THEN '{"resolved": "no"}' WHEN 2 THEN '{"resolved": ""}' WHEN 3 THEN '{"resolved": 0}' WHEN 4 THEN '{"resolved": 2}' WHEN 5 THEN '{"resolved": []}' WHEN 6 THEN '{broken}' ELSE '{"other": 1}' END"""


@query(f"""SELECT doc_id, coalesce(CAST(json_extract(CASE WHEN json_valid(o) THEN o ELSE '{{}}' END, '$.resolved') AS VARCHAR), 'null') NOT IN ('null', 'false', '0', '""', '[]', '{{}}') AS resolved
FROM (SELECT doc_id, regexp_extract({_JUDGE}, '(?s)\\{{.*\\}}') AS o FROM documents)""")
def judge_reply(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.says_resolved(F.expr(_JUDGE)).alias("resolved"))


_DESCRIBED = """CASE doc_id % 2 WHEN 0 THEN concat('{"purpose": "p', doc_id, '", "scenario": "', lang, '", "expected_behavior": ""}') ELSE concat('plain ', source) END"""


@query(f"""SELECT doc_id, CASE WHEN json_valid(r) THEN json_extract_string(r, '$.purpose') ELSE r END AS purpose, CASE WHEN json_valid(r) THEN json_extract_string(r, '$.scenario') ELSE '' END AS scenario, '' AS expected_behavior
FROM (SELECT doc_id, {_DESCRIBED} AS r FROM documents)""")
def describe_test(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.test_description(F.expr(_DESCRIBED)).alias("d")).select("doc_id", "d.*")


@query("""SELECT doc_id, len(t)::BIGINT AS n FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['a', source] ELSE [source] END AS t FROM documents)""")
def nested_json(spark, sf_dir):
    i = F.col("doc_id")
    inside = F.when(i % 2 == 0, F.to_json(F.struct(F.to_json(F.array(F.lit("a"), F.col("source"))).alias("t")))).otherwise(F.to_json(F.struct(F.array("source").alias("t"))))
    v = text.unnested(F.try_variant_get(F.try_parse_json(inside), "$.t", "variant"))
    return _docs(spark, sf_dir).select("doc_id", long(F.size(F.try_variant_get(v, "$", "array<string>"))).alias("n"))


@query("""SELECT event_id, 'own__' || event_type || '-' || CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y%m%d%H%M%S') ELSE 'r-' || event_id END AS id FROM events""")
def synthetic_ids(spark, sf_dir):
    i = F.col("event_id")
    original = F.when(i % 3 != 0, F.concat(F.when(i % 3 == 1, "o__x__r-").otherwise("r-"), i.cast("string")))
    return table(spark, sf_dir, "events").select("event_id", text.synthetic_id(F.lit("own"), F.col("event_type"), original, F.col("ts")).alias("id"))


@query(f"""SELECT doc_id, 'outer' || doc_id AS name, 1 AS start_line, 4 AS end_line FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'inner', 2, 3 FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'g' || doc_id, 1, 3 FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 'if', 2, 2 FROM documents WHERE doc_id % 2 = 1""")
def function_finder(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    py = F.concat(F.lit("def outer"), i, F.lit("():\n    def inner():\n        pass\n    return inner\n"))
    ts = F.concat(F.lit("function g"), i, F.lit("(x) {\n  if (x) { return '}' }\n}\n"))
    even = F.col("doc_id") % 2 == 0
    files = _docs(spark, sf_dir).select(F.concat(i, F.when(even, ".py").otherwise(".ts")).alias("filepath"), F.when(even, py).otherwise(ts).alias("content"))
    return code.functions(files).select(long(F.substring_index("filepath", ".", 1)).alias("doc_id"), "name", "start_line", "end_line")
