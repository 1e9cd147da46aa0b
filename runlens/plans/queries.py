"""Registered queries of the reference's operators over the driver's tables, with DuckDB SQL for each where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import code, text
from runlens.functions.ids import number_of, repo_of, scope_key, scope_kind
from runlens.operators import copies, retrieval, runs, scopes, skills, trajectories
from runlens.plans.registry import long, query, table

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(rf"""
WITH t AS (SELECT doc_id, coalesce({_TOKENS}, []) AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t),
p AS (SELECT doc_id, len AS len, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM t) GROUP BY ALL),
d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
q AS (SELECT item_id, token, count(*) AS qn FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
x AS (SELECT item_id, doc_id, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS score
      FROM q JOIN p USING (token) JOIN d USING (token), s GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x)
SELECT item_id, doc_id, rank::BIGINT AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def bm25_topk(spark, sf_dir):
    out = retrieval.top_k(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5)
    return out.select(F.col("query_id").alias("item_id"), "doc_id", long("rank").alias("rank"), F.round("score", 6).alias("score"))


@query(rf"""
WITH i AS (SELECT doc_id, source AS repo, doc_id AS num, {_TOKENS} AS t FROM documents),
q AS (SELECT item_id, 'src' || (item_id % 20) AS repo, item_id * 20 AS now, {_TOKENS} AS t FROM benchmark),
c AS (SELECT q.item_id, q.repo, count(*) AS n, avg(len(i.t)) AS a FROM q JOIN i ON i.repo = q.repo AND i.num <= q.now GROUP BY ALL),
qt AS (SELECT item_id, repo, now, token, count(*) AS qn FROM (SELECT item_id, repo, now, unnest(t) AS token FROM q) GROUP BY ALL),
p AS (SELECT doc_id, repo, num, len, token, count(*) AS tf FROM (SELECT doc_id, repo, num, len(t) AS len, unnest(t) AS token FROM i) GROUP BY ALL),
d AS (SELECT item_id, qt.repo, token, count(*) AS df FROM qt JOIN p USING (repo, token) WHERE num <= now GROUP BY ALL)
SELECT item_id, qt.repo AS repo, doc_id, round(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 6) AS score
FROM qt JOIN p USING (repo, token) JOIN d USING (item_id, repo, token) JOIN c USING (item_id, repo) WHERE num <= now GROUP BY ALL""")
def bm25_asof(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), F.col("doc_id").alias("num"), "text")
    q = table(spark, sf_dir, "benchmark").select("item_id", "text", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo"))
    q = q.select(F.concat_ws("|", F.col("item_id").cast("string"), "repo").alias("query_id"), "repo", (F.col("item_id") * 20).alias("num"), "text")
    part = F.split("query_id", r"\|")
    return retrieval.scores_as_of(items, q).select(long(part[0]).alias("item_id"), part[1].alias("repo"), "doc_id", F.round("score", 6).alias("score"))


_ID = "concat(source, '__', lang, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '-' END, doc_id)"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(i, '^(.+)-([0-9]+)$') THEN regexp_extract(i, '^(.+)-([0-9]+)$', 1) ELSE i END AS repo,
CASE WHEN regexp_matches(i, '^(.+)-([0-9]+)$') THEN regexp_extract(i, '^(.+)-([0-9]+)$', 2)::BIGINT ELSE 0 END AS num FROM (SELECT doc_id, {_ID} AS i FROM documents)""")
def parse_instance_id(spark, sf_dir):
    i = F.expr(f"{_ID}")
    return table(spark, sf_dir, "documents").select("doc_id", repo_of(i).alias("repo"), number_of(i).alias("num"))


def _leak_tables(spark, sf_dir):
    named = lambda d: F.concat(F.col("source"), F.lit("-"), F.col(d).cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    items = docs.select(named("doc_id").alias("source_instance_id"), F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / 2).cast("string")).alias("original_instance_id"))
    bad = docs.join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id").select(named("doc_id").alias("instance_id"))
    return items, bad


_LEAK = """WITH i AS (SELECT source, doc_id, doc_id // 2 AS num FROM documents),
e AS (SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
m AS (SELECT source, min(doc_id) AS least FROM e WHERE doc_id <> 0 GROUP BY source)
SELECT concat(i.source, '-', i.doc_id) AS source_instance_id, concat(i.source, '-', i.num) AS original_instance_id FROM i LEFT JOIN m USING (source) WHERE """
_EXACT, _TEMPORAL = "(i.source, i.doc_id) NOT IN (SELECT (source, doc_id) FROM e)", "(least IS NULL OR num <= least)"


@query(_LEAK + _EXACT)
def leakage_exact(spark, sf_dir):
    return skills.drop_exact(*_leak_tables(spark, sf_dir)).select("source_instance_id", "original_instance_id")


@query(_LEAK + _TEMPORAL)
def leakage_temporal(spark, sf_dir):
    return skills.drop_temporal(*_leak_tables(spark, sf_dir)).select("source_instance_id", "original_instance_id")


@query(_LEAK + _EXACT + " AND " + _TEMPORAL)
def leakage_full(spark, sf_dir):
    return skills.drop_leaks(*_leak_tables(spark, sf_dir)).select("source_instance_id", "original_instance_id")


@query("""WITH l AS (SELECT source, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents JOIN labels USING (doc_id) GROUP BY source),
g AS (SELECT source, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents WHERE lang = 'en' GROUP BY source)
SELECT coalesce(l.source, g.source) AS repo_id, coalesce(l.n, 0) AS n_local, coalesce(g.n, 0) AS n_global, coalesce(l.ids, '') AS local_ids, coalesce(g.ids, '') AS global_ids
FROM l FULL JOIN g ON l.source = g.source""")
def repo_aggregate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    rec = lambda d: d.select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("instance_id"), F.col("doc_id").alias("line_no"), F.array(F.col("doc_id").cast("string")).alias("items"))
    local = skills.aggregate_by_repo(rec(docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")))
    both = skills.merge_tables(local, skills.aggregate_by_repo(rec(docs.filter("lang = 'en'"))))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["item"]), ",")
    return both.select("repo_id", long(F.size("local_items")).alias("n_local"), long(F.size("global_items")).alias("n_global"), ids("local_items").alias("local_ids"), ids("global_items").alias("global_ids"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce('s' || b.toxic, 'p' || a.quality) AS value
FROM (SELECT doc_id, quality FROM labels) a FULL JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) b ON a.doc_id = b.doc_id""")
def merge_override(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    v = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("value")
    return skills.override(l.select("doc_id", v("p", "quality")), l.filter("toxic = 1").select("doc_id", v("s", "toxic")), "doc_id", "value")


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))


_STEPS = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_index, turn, length(content) AS n_content, length(obs) AS n_observation FROM
(SELECT conv_id, turn, role, coalesce(text, '') AS content, lead(role) OVER w AS nr, lead(coalesce(text, '')) OVER w AS obs FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant' AND nr = 'user' AND length(obs) > 100"""


@query(_STEPS)
def traj_steps(spark, sf_dir):
    out = trajectories.steps(_messages(spark, sf_dir), "conv_id", "turn", F.length("observation") > 100)
    return out.select("conv_id", long("step_index").alias("step_index"), "turn", long(F.length("content")).alias("n_content"), long(F.length("observation")).alias("n_observation"))


@query("""SELECT conv_id, page, count(*) AS n_messages, min(turn) AS first_turn FROM (SELECT conv_id, turn,
coalesce(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page FROM conversations) GROUP BY ALL""")
def traj_pages(spark, sf_dir):
    return trajectories.pages(_messages(spark, sf_dir), "conv_id", "turn").groupBy("conv_id", long("page").alias("page")).agg(F.count("*").alias("n_messages"), F.min("turn").alias("first_turn"))


@query("""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, content, obs FROM
(SELECT conv_id, turn, role, coalesce(text, '') AS content, lead(role) OVER w AS nr, lead(coalesce(text, '')) OVER w AS obs FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant' AND nr = 'user')
SELECT conv_id, sha256(string_agg('=== Step ' || i || ' ===' || CASE WHEN content <> '' THEN chr(10) || '[Thought] ' || content ELSE '' END || CASE WHEN obs <> '' THEN chr(10) || '[Action] ' || obs ELSE '' END || chr(10), chr(10) ORDER BY i)) AS digest
FROM s WHERE content <> '' OR obs <> '' GROUP BY conv_id""")
def traj_render(spark, sf_dir):
    s = trajectories.steps(_messages(spark, sf_dir), "conv_id", "turn", F.lit(True)).withColumnsRenamed({"content": "thought", "observation": "action"})
    return trajectories.render(s, "conv_id").select("conv_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_EV = "(SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"


@query(f"""WITH c AS (SELECT user_id, 'f' || (k % 10) || '.py' || CASE WHEN event_type IN ('click', 'view') THEN '' ELSE '::' || event_type END AS scope_key,
CASE WHEN event_type IN ('click', 'view') THEN 'file' ELSE 'function' END AS kind, count(*) AS n FROM {_EV} GROUP BY ALL),
m AS (SELECT user_id, scope_key, max(n) AS n, max(CASE kind WHEN 'function' THEN 3 ELSE 1 END) AS sp FROM c GROUP BY ALL)
SELECT * FROM (SELECT user_id, scope_key, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, sp DESC, scope_key) AS rank FROM m) WHERE rank <= 3""")
def access_rank(spark, sf_dir):
    e = _events(spark, sf_dir)
    fn = F.when(~F.col("event_type").isin("click", "view"), F.col("event_type"))
    path = F.concat(F.lit("f"), (F.col("k") % 10).cast("string"), F.lit(".py"))
    counts = e.select("user_id", scope_key(path, F.lit(None).cast("string"), fn).alias("scope_key"), scope_kind(F.lit(None), fn).alias("kind")).groupBy("user_id", "scope_key", "kind").count()
    return scopes.rank_candidates(counts, 3, "user_id").select("user_id", "scope_key", F.col("count").alias("n"), long("rank").alias("rank"))


@query(f"""WITH s AS (SELECT p_brand AS filepath, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'C' || (p_partkey % 7) END AS c, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE 'f' || (p_partkey % 11) END AS f, p_size AS a, p_size + 9 AS z FROM part),
r AS (SELECT event_id, 'Brand#' || (11 + user_id % 5) AS filepath, k AS x, k + 5 AS y FROM {_EV}),
h AS (SELECT DISTINCT event_id, c, f FROM (SELECT event_id, c, f, count(f) OVER (PARTITION BY event_id, c) AS m FROM r JOIN s USING (filepath) WHERE a <= y AND x <= z) WHERE f IS NOT NULL OR (c IS NOT NULL AND m = 0) OR c IS NULL)
SELECT r.event_id AS event_id, concat_ws('::', filepath, c, f) AS scope_key FROM r LEFT JOIN h USING (event_id)""")
def scope_overlap(spark, sf_dir):
    p = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("filepath"), F.when(p % 3 != 0, F.concat(F.lit("C"), (p % 7).cast("string"))).alias("class_name"), F.when(p % 3 != 1, F.concat(F.lit("f"), (p % 11).cast("string"))).alias("function_name"), F.col("p_size").alias("start_line"), (F.col("p_size") + 9).alias("end_line"))
    r = _events(spark, sf_dir).select(F.col("event_id").alias("range_id"), F.concat(F.lit("Brand#"), (11 + F.col("user_id") % 5).cast("string")).alias("filepath"), F.col("k").alias("start_line"), (F.col("k") + 5).alias("end_line"))
    return scopes.align(r, s).select(F.col("range_id").alias("event_id"), "scope_key")


_ISLANDS = f"""WITH i AS (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS g FROM (SELECT DISTINCT user_id, k FROM {_EV})),
b AS (SELECT user_id, min(k) AS start_line, max(k) AS end_line, count(*) AS n_lines FROM i GROUP BY user_id, g HAVING count(*) >= 3)"""


@query(_ISLANDS + "SELECT * FROM b")
def line_islands(spark, sf_dir):
    return scopes.line_islands(_events(spark, sf_dir), ["user_id"], "k")


@query(_ISLANDS + f""", s AS (SELECT user_id, min(k) AS lo, max(k) AS hi FROM {_EV} GROUP BY user_id),
f AS (SELECT p_partkey % 50 AS user_id, p_size AS a, p_size + p_partkey % 150 AS z FROM part),
c AS (SELECT user_id, a::BIGINT AS start_line, z::BIGINT AS end_line, 'function' AS kind FROM f JOIN s USING (user_id) WHERE a <= hi AND z >= lo AND z - a + 1 <= 120)
SELECT * FROM c UNION ALL SELECT user_id, start_line, end_line, 'block' FROM b WHERE user_id NOT IN (SELECT user_id FROM c)""")
def segment_policy(spark, sf_dir):
    p = F.col("p_partkey")
    f = table(spark, sf_dir, "part").select((p % 50).alias("user_id"), long("p_size").alias("start_line"), (F.col("p_size") + p % 150).alias("end_line"))
    return scopes.segments(_events(spark, sf_dir).select("user_id", F.col("k").alias("line")), f, ["user_id"])


@query("""SELECT doc_id, coalesce(quality = 1, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 = 0 END, CASE WHEN doc_id % 5 = 0 THEN true END, false) AS resolved FROM documents LEFT JOIN labels USING (doc_id)""")
def resolved_chain(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", (F.col("quality") == 1).alias("eval_resolved"), F.when(d % 2 == 0, d % 3 == 0).alias("all_passed"), F.when(d % 5 == 0, F.lit(True)).alias("agent_success"), F.lit(False).alias("judge_resolved"))
    return rows.select("doc_id", runs.resolved(rows).alias("resolved"))


@query("""WITH t AS (SELECT doc_id, source, n_chars // 50 AS bucket, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS w FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM t a JOIN t b ON a.source = b.source AND a.bucket = b.bucket AND a.doc_id < b.doc_id WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT a, b FROM p WHERE i / (n - i) >= 0.75""")
def copy_check(spark, sf_dir):
    part = F.when(F.col("source").isNotNull() & F.col("n_chars").isNotNull(), F.struct("source", F.floor(F.col("n_chars") / 50).alias("bucket")))
    return copies.near_pairs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), part.alias("part"), text.copy_tokens(F.col("text")).alias("tokens")), 0.75)


_MARKED = "concat('# Title', chr(10), 'See https://x.example/a?b=1 and ', text, chr(10), '**Bold**', chr(10), 'Thanks all', chr(10), '## More ', chr(10), 'end')"


@query(rf"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKED}, '(?s)```.*?```', ' ', 'g'), 'https?://\S+', ' ', 'g'), '(?m)^#+\s*.*$', ' ', 'g'), '(?m)^\*\*.*?\*\*\s*$', ' ', 'g'), '(?mi)^\s*(?:thanks|thank you).*$', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, sha256(CASE WHEN length(t) > 1200 THEN rtrim(left(t, 1200)) ELSE t END) AS digest FROM c""")
def clean_statement(spark, sf_dir):
    marked = F.expr(_MARKED.replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.clean_statement(marked).cast("binary"), 256).alias("digest"))


@query(rf"""SELECT doc_id, nullif(left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKED}, '(?s)```.*?```', ' ', 'g'), '(?m)^#+\s*', '', 'g'), '(?m)^\*\*.*?\*\*\s*:?\s*$', ' ', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')), 240), '') AS focus FROM documents""")
def normalize_focus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise_focus(F.expr(_MARKED.replace("chr(10)", "'\\n'"))).alias("focus"))


@query("""SELECT doc_id, sha256(CASE WHEN length(text) < 10000 THEN text ELSE left(text, 5000) || chr(10) || '<elided_chars>' || chr(10) || (length(text) - 10000) || ' characters elided' || chr(10) || '</elided_chars>' || chr(10) || right(text, 5000) END) AS digest FROM documents""")
def observation_elide(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.elide(F.col("text")).cast("binary"), 256).alias("digest"))


@query("""SELECT status, n, CASE WHEN length(l) > 55 THEN left(l, 52) || '...' ELSE rpad(l, 55, ' ') END AS latest FROM
(SELECT event_type AS status, count(*) AS n, string_agg(event_id::VARCHAR, ', ' ORDER BY event_id DESC) AS l FROM events GROUP BY event_type)""")
def status_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), "event_id", F.col("event_id").alias("arrival"))
    return runs.status_report(e, "status", "event_id", "arrival")


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS syntax_error, count(*) FILTER (event_type = 'view') AS test_passed, count(*) FILTER (event_type NOT IN ('click', 'view')) AS other FROM events""")
def failure_breakdown(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count_if(t == "click").alias("syntax_error"), F.count_if(t == "view").alias("test_passed"), F.count_if(~t.isin("click", "view")).alias("other"))


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1) AS successful, count(*) FILTER (quality IS DISTINCT FROM 1) AS failed, round(coalesce(count(*) FILTER (quality = 1) / count(*), 0), 6) AS success_rate FROM labels""")
def run_summary(spark, sf_dir):
    out = runs.run_summary(table(spark, sf_dir, "labels"), F.col("quality") == 1)
    return out.withColumn("success_rate", F.round("success_rate", 6))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS passed, count(*) FILTER (event_type = 'view') AS failed, count(*) FILTER (event_type NOT IN ('click', 'view')) AS errors,
coalesce(string_agg(CASE WHEN event_type = 'click' THEN event_id::VARCHAR END, ',' ORDER BY event_id), '') AS passed_ids FROM events GROUP BY user_id""")
def verify_totals(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(t == "click").alias("passed"), F.count_if(t == "view").alias("failed"), F.count_if(~t.isin("click", "view")).alias("errors"), F.array_join(F.array_sort(F.collect_list(F.when(t == "click", F.col("event_id")))), ",").alias("passed_ids"))


@query("""SELECT source, count(*) AS n FROM documents GROUP BY source""")
def count_by_origin(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, count(*) OVER w AS n, coalesce(sum(value) OVER w, 0) AS s FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n < 20 AND s < 500""")
def limit_crossing(spark, sf_dir):
    return runs.calls_before_limit(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 20, 500.0).select("user_id", "event_id")


@query("""SELECT conv_id, turn, (['m0', 'm0', 'm1'])[(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 + 1] AS model FROM conversations""")
def interleave(spark, sf_dir):
    return runs.interleave(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", ["m0", "m0", "m1"])


@query("""WITH a AS (SELECT user_id, event_type, event_id, value > 20 AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
SELECT user_id, event_type, min_by(event_id, n) FILTER (ok) AS value, coalesce(min(n) FILTER (ok), max(n)) AS attempts FROM a WHERE n <= 3 GROUP BY ALL""")
def first_valid_attempt(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = runs.first_valid(e, ["user_id", "event_type"], ["event_id"], F.col("value") > 20, "event_id")
    return out.withColumn("attempts", long("attempts"))


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents WHERE regexp_matches(doc_id::VARCHAR, '^(?:[1-4])')) WHERE i >= n - 100 AND i < n - 10 AND (i - (n - 100)) % 3 = 0""")
def select_instances(spark, sf_dir):
    return runs.select_instances(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", pattern="[1-4]", slice_spec="-100:-10:3")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_antijoin(spark, sf_dir):
    return runs.not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT user_id, event_id, event_type, CASE WHEN event_id % 10 <> 5 THEN value END AS value,
row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) WHERE i = 1 AND value IS NOT NULL""")
def preds_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 10 != 5, F.col("value")).alias("value"))
    return runs.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "event_id")


_INJECT = f"""SELECT user_id AS run_id, 'f' || (k % 20) || '.py::g' AS api_path, min(event_id) AS pos FROM {_EV}
WHERE k % 20 IN (SELECT doc_id % 20 FROM labels WHERE quality = 0) GROUP BY ALL"""


@query(_INJECT)
def inject_once(spark, sf_dir):
    path = lambda c: F.concat(F.lit("f"), (F.col(c) % 20).cast("string"), F.lit(".py"))
    mentions = _events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), path("k").alias("filepath"))
    l = table(spark, sf_dir, "labels")
    items = l.select(F.concat(path("doc_id"), F.lit("::g")).alias("api_path"), F.col("doc_id").alias("source_instance_id"))
    return skills.first_injections(mentions, items, l.filter("quality = 0").select(F.col("doc_id").alias("source_instance_id")))


@query(f"""SELECT c.doc_id AS current_id, i.doc_id AS item_id FROM documents c JOIN documents i ON c.source = i.source AND i.doc_id // 2 <= c.doc_id WHERE c.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def temporal_admission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    name = lambda c: F.concat("source", F.lit("-"), c.cast("string"))
    items = docs.select(F.col("doc_id").alias("item_id"), name(F.floor(F.col("doc_id") / 2)).alias("original_instance_id"), name(F.col("doc_id")).alias("source_instance_id"))
    now = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id").select(name(F.col("doc_id")).alias("current_id"))
    return skills.admitted(items, now).select(F.col("now").alias("current_id"), "item_id")


def _values(spark, rows: list[str], name: str = "value") -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), f"id bigint, {name} string")


@query("""SELECT * FROM (VALUES (0::BIGINT, 'pkg/a.py,b/c.ts'), (1, 'conf.js'), (2, 'x.py'), (3, 'foo.py'), (4, '')) t(id, paths)""")
def path_mentions(spark, sf_dir):
    v = _values(spark, ["cat /testbed/pkg/a.py && sed -n '1,5p' ./b/c.ts", "cat conf.json", "python -m x.pyc", "cat foo.py.bak", "ls"])
    return v.select("id", F.array_join(text.path_mentions(F.col("value")), ",").alias("paths"))


@query("""SELECT * FROM (VALUES (0::BIGINT, 'no fence ', ''), (1, 'think', 'ls -la'), (2, 'x', 'open end')) t(id, thought, action)""")
def parse_message(spark, sf_dir):
    v = _values(spark, ["no fence ", "think\n```bash\nls -la\n```\nrest", "x ```bash open end"])
    return v.select("id", text.parse_message(F.col("value")).alias("m")).select("id", "m.*")


@query("""SELECT * FROM (VALUES (0::BIGINT, NULL, 'FormatError: 0'), (1, 'ls', NULL), (2, NULL, 'FormatError: 2')) t(id, action, error)""")
def parse_action(spark, sf_dir):
    v = _values(spark, ["none", "a\n```bash\nls\n```", "```bash\na\n```\n```bash\nb\n```"])
    return v.select("id", text.parse_action(F.col("value")).alias("m")).select("id", "m.*")


@query("""SELECT * FROM (VALUES (0::BIGINT, 'y.py,z/q.go'), (1, '')) t(id, files)""")
def diff_files(spark, sf_dir):
    v = _values(spark, ["diff --git a/x.py b/y.py\n+1\ndiff --git a/z/q.go b/z/q.go\n", "nothing"])
    return v.select("id", F.array_join(text.diff_files(F.col("value")), ",").alias("files"))


@query("""SELECT * FROM (VALUES (0::BIGINT, 'pkg/a.py', 'SEARCH', 3, 3), (1, 'src/a.py', 'SEARCH', 7, 7), (2, 'pkg/a.py', 'EDIT', 10, 12), (3, 'a.py', 'VIEW', 1, 20), (4, 'a.py', 'VIEW', NULL, NULL), (5, 'pkg/b.go', 'VIEW', 2, 9), (6, 'c.ts', 'VIEW', NULL, NULL),
(8, 'a.py', 'VIEW', 5, 5), (9, 'a.py', 'VIEW', 3, 4), (10, 'a.py', 'VIEW', 1, 3), (11, 'a.py', 'SEARCH', NULL, NULL)) t(id, filepath, access_type, start_line, end_line)""")
def access_extract(spark, sf_dir):
    rows = [(0, 'grep -n "def f" pkg/a.py', "3:def f():"), (1, "grep -rn foo src/ | head -5", "src/a.py:7:foo"), (2, "sed -i '10,12s/a/b/' /testbed/pkg/a.py", ""), (3, "head -n 20 a.py", ""), (4, "tail -n 20 a.py", ""), (5, "sed -n '2,9p' ./pkg/b.go", ""), (6, "cat c.ts", ""),
        (7, "grep foo", ""), (8, "nl -ba a.py | sed -n '5p'", ""), (9, "sed  -n '3,4p' a.py", ""), (10, "head -n 3 a.py; tail -n 2 b.py", ""), (11, "grep foo a.py", "")]
    df = spark.createDataFrame(rows, "id bigint, action string, observation string")
    return trajectories.accesses(df).select("id", "filepath", "access_type", "start_line", "end_line")


@query("""SELECT * FROM (VALUES (0::BIGINT, 'Submitted'), (1, 'continue'), (2, 'continue'), (3, 'continue'), (4, 'Submitted')) t(id, state)""")
def submission_state(spark, sf_dir):
    v = _values(spark, [f"{text.SUBMIT}\ndiff --git", text.SUBMIT, f"{text.SUBMIT}\nfatal: x", "other", f"{text.SUBMIT_LEGACY}\n"])
    return v.select("id", text.submission_state(F.col("value")).alias("state"))


@query("""SELECT * FROM (VALUES ('pkg/a.go', 2), ('pkg/a.go', 3), ('pkg/a.go', 4)) t(file, line)""")
def coverage_go(spark, sf_dir):
    v = _values(spark, ["mode: set", "mod/pkg/a.go:2.1,4.2 2 1", "mod/pkg/a.go:9.1,9.9 1 0", "mod/pkg/a_test.go:1.1,2.2 1 1"])
    return scopes.go_coverage(v, "mod")


@query("""SELECT * FROM (VALUES ('a.ts', 2), ('a.ts', 3), ('a.ts', 4)) t(file, line)""")
def coverage_jest(spark, sf_dir):
    j = '{"/r/a.ts": {"statementMap": {"0": {"start": {"line": 2}, "end": {"line": 4}}, "1": {"start": {"line": 9}, "end": {"line": 9}}}, "s": {"0": 1, "1": 0}}, "/r/a.test.ts": {"statementMap": {"0": {"start": {"line": 1}, "end": {"line": 1}}}, "s": {"0": 3}}}'
    return scopes.jest_coverage(_values(spark, [j]), "/r/")


@query("""SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT), (1, NULL), (2, NULL), (3, NULL), (4, NULL)) t(id, n_items)""")
def validate_skills(spark, sf_dir):
    v = _values(spark, ['[{"api_path": "a.py", "experience_or_reflection": "", "thinking": "t"}]', '[{"api_path": "a.py", "experience_or_reflection": "e", "thinking": ""}, {"api_path": "z.py", "experience_or_reflection": "e", "thinking": ""}]', "broken",
        '[{"api_path": "a.py", "experience_or_reflection": "e"}]', '[{"api_path": "a.py", "experience_or_reflection": 5, "thinking": ""}]'], "response")
    return skills.valid_local(v.withColumn("candidates", F.array(F.lit("a.py")))).select("id", long(F.size("items")).alias("n_items"))


@query()
def py_scopes(spark, sf_dir):
    src = 'class C:\n    """doc"""\n    def m(self):\n        pass\n\ndef f():\n    pass\n'
    return code.scopes(spark.createDataFrame([("a.py", src), ("bad.py", "def ("), ("b.go", "type T struct {\n}\nfunc (t T) m() {\n}\n"), ("c.ts", "class K {\n}\nfunction g() {\n}\n")], "filepath string, content string"))


@query()
def splice_and_diff(spark, sf_dir):
    files = spark.createDataFrame([("a.py", "1\n2\n3\n4")], "filepath string, content string")
    edits = spark.createDataFrame([("a.py", 2, 2, "x\ny"), ("a.py", 4, 4, "z")], "filepath string, start_line int, end_line int, code string")
    done = code.splice(files, edits)
    return done.select("filepath", "edited", code.unified_diff("content", "edited", "filepath").alias("patch"))
