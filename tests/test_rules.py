"""Operators against cases written from the rules they follow, not from their own results."""

import json

from pyspark.sql import functions as F

from runlens.functions import code, text
from runlens.operators import runs, skills
from runlens.sources import files
from runlens.streaming import injection


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_brace_scopes():
    source = """export async function a(x) {
  const s = "}" + '{';
}
const b = (y) => {
  return `}`;
};
func (t *T) C(z int) error {
  if z { return nil }
}
class D { e() { return 1; } }
function a() { // the last of a name stands
  return 2;
}
function open() { 'no end }
"""
    assert code.brace_scopes(source) == [(None, "a", 11, 13, None), (None, "b", 4, 6, None), (None, "C", 7, 9, None), (None, "open", 14, 14, None)]
    assert code.brace_scopes("// don't\nfunction f() {\n}\n") == [(None, "f", 2, 3, None)]
    assert code.brace_scopes("") == []


def test_reindent(spark):
    rows = [("\n  a\n\tb\n   \n    c\n", 4), ("  \n", 2), (None, 0), ("x\n  y ", 0)]
    got = [r.r for r in spark.createDataFrame(rows, "v string, n int").select(code.reindent("v", "n").alias("r")).collect()]
    assert got == ["\n     a\n    b\n\n       c\n", "  pass", "pass", "x\n  y "]


def test_code_block_and_brackets(spark):
    assert one(spark, "f(a[1", text.close_brackets) == "f(a[1)]"
    assert one(spark, "f(a if b  ", text.close_brackets) == "f(a if b else None)"
    assert one(spark, "f(a if b else c", text.close_brackets) == "f(a if b else c)"
    assert one(spark, "a if b", text.close_brackets) == "a if b"
    assert one(spark, "say ```python\nf({1\n``` end", text.code_block) == "f({1)}"


def test_valid_skills(spark):
    def items(check, *responses):
        rows = spark.createDataFrame([(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(responses)], "id int, response string")
        out = check(rows.withColumn("candidates", F.array(F.lit("a"), F.lit("b")))).orderBy("id").collect()
        return [r["items"] and [x.asDict(True) for x in r["items"]] for r in out]

    local = {"api_path": "a", "experience_or_reflection": "", "thinking": "t"}
    assert items(skills.valid_local, [local], [local, {**local, "api_path": "c"}], [{**local, "thinking": 1}], [{**local, "thinking": None}], "no json", {"x": 1}) == [[local], None, None, None, None, None]
    whole = {"api_path": "a", "purpose": "", "playbook": "", "thinking": "", "related_apis": []}
    related = [{"api_path": "b", "reason": ""}, {"api_path": "a", "reason": "r"}]
    got = items(skills.valid_global, [{"api_path": "a", "purpose": ""}], [{**whole, "related_apis": ["b", {"api_path": "a", "reason": "r"}]}], [{**whole, "playbook": 3}], [{**whole, "related_apis": "b"}], [{**whole, "related_apis": ["c"]}], [{**whole, "related_apis": [{"api_path": "b", "reason": 1}]}], [{"api_path": "a"}])
    assert got == [[whole], [{**whole, "related_apis": related}], None, None, None, None, None]


def test_upsert_and_its_sink(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "key string, at int, value string")
    log = spark.createDataFrame([("a", 2, None), ("c", 3, "z"), ("b", 2, None), ("b", 4, "w")], "key string, at int, value string")
    assert sorted(tuple(r) for r in runs.upsert(base, log, "key", "at").collect()) == [("b", 4, "w"), ("c", 3, "z")]
    sink = injection.upsert_sink(str(tmp_path / "t"), "key", "at")
    sink(base, 0)
    sink(log, 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()) == [("b", 4, "w"), ("c", 3, "z")]


def test_status_report(spark):
    rows = spark.createDataFrame([("s", f"instance-{i:03}", i) for i in range(200)] + [("t", "one", 1)], "status string, id string, at int")
    got = {r.status: (r.n, r.latest) for r in runs.status_report(rows, "status", "id", "at").collect()}
    assert got == {"s": (200, "instance-199, instance-198, instance-197, instance-1..."), "t": (1, "one".ljust(55))}


def test_golden_forms(spark, tmp_path):
    forms = {"map.json": json.dumps({"k1": {"patch": "p"}, "k2": {"instance_id": "other", "patch": "q"}, "k3": 5}), "list.json": json.dumps([{"instance_id": "a"}, {"instance_id": "a", "v": 2}, {"x": 1}]), "lines.jsonl": '{"instance_id": "l1"}\nbroken\n\n{"instance_id": "l2"}\n'}
    for name, content in forms.items():
        (tmp_path / name).write_text(content)
    read = lambda name, **o: {r.instance_id: json.loads(r.record) for r in files.golden(spark, str(tmp_path / name), **o).collect()}
    assert read("map.json") == {"k1": {"patch": "p"}, "k2": {"instance_id": "other", "patch": "q"}}
    assert read("list.json") == {"a": {"instance_id": "a", "v": 2}}
    assert read("list.json", first_wins=True) == {"a": {"instance_id": "a"}}
    assert read("lines.jsonl").keys() == {"l1", "l2"}
