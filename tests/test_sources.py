"""Readers and writers on small trees."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.operators import prompts, segments, skills
from runlens.sources import files


def put(root, path, content):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(content)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_trajectories(spark, tmp_path):
    said = [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}]}, {"role": "assistant", "content": "c"}]
    put(tmp_path, "r1/x.traj.json", "[]")
    put(tmp_path, "r1/r1_trajectory.json", json.dumps({"info": {"instance_id": "i-1"}, "messages": said}))
    put(tmp_path, "r2/b_trajectory.json", json.dumps(said[1:]))
    put(tmp_path, "r2/other.json", "{}")
    put(tmp_path, "r3/bad.traj.json", "{broken")
    chosen = files.trajectory_files(spark, str(tmp_path))
    assert [(r.run_dir, r.path.rpartition("/")[2]) for r in chosen.orderBy("run_dir").collect()] == [("r1", "r1_trajectory.json"), ("r2", "b_trajectory.json"), ("r3", "bad.traj.json")]
    assert rows(files.trajectory_messages(chosen)) == [("r1", "i-1", 0, "user", "a\n\nb"), ("r1", "i-1", 1, "assistant", "c"), ("r2", "r2", 0, "assistant", "c")]


def test_saved_trajectories_are_replaced_one_by_one(spark, tmp_path):
    out = str(tmp_path / "t")
    shape = "instance_id string, exit_status string, submission string, instance_cost double, api_calls int, messages array<struct<role:string,content:string>>, extra struct<repo:string>"
    files.save_trajectories(spark.createDataFrame([("a-1", "in_progress", "", None, 1, [("user", "x")], ("r",)), ("b-2", "Submitted", "d", 0.5, 2, [], None)], shape), out)
    files.save_trajectories(spark.createDataFrame([("a-1", "Submitted", None, 1.5, 3, [("user", "x"), ("assistant", "y")], ("r",))], shape), out)
    got = {r.instance_id: json.loads(r.value) for r in spark.read.text(out).collect()}
    assert got.keys() == {"a-1", "b-2"} and got["b-2"]["info"]["repo"] is None
    assert got["a-1"]["info"] == {"exit_status": "Submitted", "submission": None, "model_stats": {"instance_cost": 1.5, "api_calls": 3}, "repo": "r"}
    assert [m["content"] for m in got["a-1"]["messages"]] == ["x", "y"]


def test_lines_lists_and_reports(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"x": 1}\r\n\n broken\n{"x": 2}')
    assert [r.line_no for r in files.jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("line_no").collect()] == [0, 3]
    with pytest.raises(Exception, match="MALFORMED"):
        files.jsonl(spark, str(tmp_path / "a.jsonl"), lenient=False).collect()
    put(tmp_path, "ids.txt", " a-1 \n\nb-2\n")
    assert rows(files.id_list(spark, str(tmp_path / "ids.txt"))) == [("a-1",), ("b-2",)]
    put(tmp_path, "report.json", json.dumps({"resolved_ids": ["a"], "unresolved_ids": ["a", "b"], "empty_patch_ids": ["c"]}))
    assert rows(files.eval_status(spark, str(tmp_path / "report.json"))) == [("a", True), ("b", False), ("c", False)]
    put(tmp_path, "tests.json", json.dumps({"a": ["t1", "t2"], "b": []}))
    assert rows(files.target_tests(spark, str(tmp_path / "tests.json"))) == [("a", 0, "t1"), ("a", 1, "t2")]
    (tmp_path / "eval/e-1").mkdir(parents=True)
    put(tmp_path, "eval/note.txt", "")
    put(tmp_path, "eval/e-2/x", "")
    assert rows(files.folder_names(spark, str(tmp_path / "eval"))) == [("e-1",), ("e-2",)]


def test_bug_instances_need_every_key(spark, tmp_path):
    whole = {"instance_id": "n-1", "base_commit": "c", "problem_statement": None, "buggy_patch": "p", "target_tests": '["t"]'}
    put(tmp_path, "o-1/t1/instances.jsonl", json.dumps(whole) + "\n" + json.dumps({k: v for k, v in whole.items() if k != "buggy_patch"}) + "\n")
    put(tmp_path, "o-1/t2/instances.jsonl", "broken\n")
    got = files.bug_instances(spark, str(tmp_path)).collect()
    assert [(r.original_instance_id, r.test, r.line_no, r.instance_id, r.target_tests) for r in got] == [("o-1", "t1", 0, "n-1", ["t"])]


def test_skill_files_and_predictions(spark, tmp_path):
    one = spark.createDataFrame([("b", 1), ("a", 2)], "repo_id string, n int")
    files.write_repo_skills(one, str(tmp_path / "s"))
    assert [r.repo_id for r in spark.read.json(str(tmp_path / "s")).collect()] == ["a", "b"]
    files.append_jsonl(one, str(tmp_path / "j"))
    files.append_jsonl(one, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    shape = "instance_id string, seq int, value string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], shape).write.parquet(str(tmp_path / "p0"))
    files.write_predictions(spark, str(tmp_path / "p0"), spark.createDataFrame([("a", 2, "z"), ("b", 2, None)], shape), str(tmp_path / "p1"))
    assert rows(spark.read.parquet(str(tmp_path / "p1"))) == [("a", 2, "z")]


def test_reports_phases_and_metadata(spark, tmp_path):
    ids = spark.createDataFrame([("s", 'a"1', 2), ("s", "b[2]", 1), ("None", "c", 1)], "status string, id string, at int")
    lines = [r.value for r in files.status_yaml(ids, "status", "id", "at").collect()]
    assert lines == ["instances_by_exit_status:", '    "None":', '    - "c"', '    "s":', '    - "b[2]"', '    - "a\\"1"']
    assert files.status_yaml(ids.limit(0), "status", "id", "at").count() == 0
    phase = lambda *r: files.write_phase(spark.createDataFrame(r, "run_id string, n int"), str(tmp_path), "segments")
    phase(("r1", 1), ("r2", 2))
    phase(("r1", 3))
    assert rows(spark.read.json(str(tmp_path / "02_segments")).select("run_id", "n")) == [("r1", 3), ("r2", 2)]
    meta = spark.createDataFrame([("i", "{}", '["a",  "b"]', "diff"), ("k", "{}", None, "[x")], "instance_id string, record string, test_patch string, patch string")
    want = [("i", "fix.patch", "diff"), ("i", "instance_data.json", "{}"), ("i", "test.patch", '["a","b"]'), ("k", "fix.patch", "[x"), ("k", "instance_data.json", "{}")]
    assert rows(files.metadata_files(meta)) == want
    files.write_metadata(meta, str(tmp_path / "m"))
    assert rows(spark.read.text(str(tmp_path / "m")).select("instance_id", "name", "value")) == want


def test_golden_join_is_strict(spark):
    runs, golden = spark.createDataFrame([("a",), ("b",)], "instance_id string"), spark.createDataFrame([("a", "p")], "instance_id string, patch string")
    assert rows(skills.with_golden(runs, golden, strict=False)) == [("a", "p"), ("b", None)]
    with pytest.raises(Exception, match="no golden record for b"):
        skills.with_golden(runs, golden).collect()


def test_rendered_skills(spark):
    tasks = spark.createDataFrame([("i", " do "), ("j", None)], "k string, task string")
    shape = "k string, o int, api_path string, purpose string, playbook string"
    items = spark.createDataFrame([("i", 2, "b", "q", "\n play\n"), ("i", 1, "a", "p", None), ("i", 3, "", "r", ""), ("i", 4, "d", "s", "")], shape)
    got = dict(rows(prompts.global_skills(tasks, items, "k", ["o"], most=3)))
    assert got == {"i": "do \n\n=== Global Diagnostic Skills ===\n- a: p\n- b: q\n  - playbook: play", "j": "=== Global Diagnostic Skills ==="}
    fired = spark.createDataFrame([(1, "b::f", 0, "e", " x "), (1, "a", 1, " ", None), (1, "b::f", 1, "g\n", "")], "run int, api_path string, o int, experience_or_reflection string, issue string")
    assert rows(prompts.local_skills(fired, ["run"], ["o"])) == [(1, "=== Local Intervention Skills ===\nAPI: a\n\nAPI: b::f\n- [x] e\n- g")]


def test_lines_and_context(spark):
    content = spark.createDataFrame([("f", "a\r\n  b  \rc\nd"), ("g", ""), ("h", None)], "filepath string, content string")
    asked = spark.createDataFrame([("f", 0), ("f", 2), ("f", 4), ("f", 5), ("g", 1), ("h", 1), ("f", 2)], "filepath string, line int")
    assert rows(segments.line_texts(asked, content)) == [("f", 2, "  b"), ("f", 4, "d")]
    cut = spark.createDataFrame([("f", 2, 2), ("f", 4, 9), ("g", 1, 1)], "filepath string, start_line int, end_line int")
    got = {(r.filepath, r.start_line): (r.code, r.context_before, r.context_after, r.base_indent, r.line_count) for r in segments.with_context(cut, content, context=1).collect()}
    assert got == {("f", 2): ("  b  ", "a\n", "c\n", 2, 1), ("f", 4): ("d", "c\n", "", 0, 6), ("g", 1): ("", "", "", 0, 1)}


def test_test_names(spark):
    body = "func TestA(t *testing.T) {}\n func TestB(\nfunc Test_C (x\nfunc TestA(\n"
    script = "it('a b ', 1); describe(\"c\"); test(`d`); it('a b', 2)"
    data = [("x/y/a_test.go", body), ("b_test.go", body), ("c.go", body), ("w/c.spec.tsx", script), ("node_modules/c.spec.ts", script), ("c.ts", script), ("d.test.js", None)]
    got = [r.test_id for r in segments.test_names(spark.createDataFrame(data, "filepath string, content string")).orderBy("filepath", "ord").collect()]
    assert got == [".::TestA", ".::Test_C", "w/c.spec.tsx::a b", "w/c.spec.tsx::c", "w/c.spec.tsx::d", "./x/y::TestA", "./x/y::Test_C"]


def test_traced_paths(spark):
    paths = ["/r/a.py", "/r/sub/test_a.py", "/r/tests/a.py", "/r/a.pyc", "/r/venv/a.py", "/q/a.py", "", None, "/r/lib/a.py", "/r/x/dist-packages/a.py"]
    out = spark.createDataFrame([(p,) for p in paths], "p string").filter(segments.traced(F.col("p"), "/r", ("/r/lib",)))
    assert rows(out) == [("/r/a.py",)]
