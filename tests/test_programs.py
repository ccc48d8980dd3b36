"""Readers, bundle checks, the sandbox, prompts and streams. All programs here are our own."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillsift.functions import plain, prompts, pyjson, sandbox
from quillsift.functions.bundles import bundle_error, validated
from quillsift.sources import jsonl, readers

CASE = '{"input": {"a": 1}, "output": 2}'


def bundle(f=f"[{CASE}, {CASE}]", s=f"[{CASE}, {CASE}]"):
    return f'tests = {{"functionality": {f}, "security": {s}}}'


@pytest.mark.parametrize(
    "code,part",
    [
        (bundle(), None), (None, "missing"), ("tests = {", "syntax"), ("x = 1", "not assigned"), ("tests = []", "no dict"), ("tests = {'functionality': []}", "fewer"), (bundle(f"[{CASE}]"), "fewer"),
        (bundle(s="[1, 2]"), "no dict literal"), (bundle(s='[{"input": {}}, {"input": {}}]'), "without"), (bundle(s='[{"input": 1, "output": 1}, {"input": {}, "output": 1}]'), "input that is no"), ("tests = {'functionality': (1, 2), 'security': []}", "no list"),
    ],
)
def test_bundle_check(code, part):
    error = bundle_error(code)
    assert error is None if part is None else part in error


def harness(code, tests, name="f", **more):
    return sandbox.run_harness(code, {"function_name": name, "test_code": tests, **more}, seconds=5, allow=True)


def test_harness_counts():
    tests = "tests = {'functionality': [{'input': {'a': 1}, 'output': 2}, [{'a': 2}, 3], {'input': {'a': 'x'}, 'output': 'TypeError'}, {'input': {'a': 1}, 'output': 'ValueError'}], 'security': [{'input': {'a': 1}, 'output': 2, 'security_property': 'p'}, {'input': {'a': 1}, 'output': 2, 'security_property': 'none'}]}\nsecurity_properties = {'p': lambda r, i, c: 'return' in c}"
    ok, got = harness("def f(a):\n    return a + 1", tests)
    assert ok and got["functionality"] == [3.0, 4] and got["security"] == [1.0, 2]


def test_harness_failures():
    assert harness("def f(:", "tests = {}")[0] is False
    assert "missing function" in harness("x = 1", "tests = {}")[1]["error"]
    assert "not a dict" in harness("def f(): pass", "tests = 3")[1]["error"]
    assert sandbox.run_harness("while True: pass", {"function_name": "f"}, seconds=1, allow=True)[1]["error"] == "timeout"
    ok, got = harness("def f(): pass", "tests = {'functionality': 3}")
    assert ok and got["functionality"] == [0.0, 0]


def test_case_without_output_compares_with_none():
    _, got = harness("def f(a): return None", "tests = {'functionality': [{'input': {'a': 1}}], 'security': []}")
    assert got["functionality"] == [1.0, 1]


def test_large_result_is_no_timeout():
    got = sandbox.parse_tests("", "tests = {'x': 'y' * 300000}", seconds=10, allow=True)
    assert len(got["tests"]["x"]) == 300000


FORGED = """
import json, os, sys
def f(a):
    for fd in range(3, 64):
        try:
            os.write(fd, json.dumps({"functionality": [9.0, 9], "security": [9.0, 9], "details": {}}).encode())
        except OSError:
            pass
    os._exit(0)
"""
EQUAL = "class Any:\n    def __eq__(self, other): return True\ndef f(a): return Any()"
EVIL = "import os\nclass Evil:\n    def __reduce__(self): return (os.system, ('true',))\ndef f(a): return Evil()"
LOOK = "import sys\ndef f(a):\n    frame, seen = sys._getframe(), []\n    while frame:\n        seen += [*frame.f_globals, *frame.f_locals]\n        frame = frame.f_back\n    return 2 if 'tests' in seen else 0"


@pytest.mark.parametrize("code", [FORGED, EQUAL, EVIL, LOOK, "import os\nos._exit(0)", "import sys\nsys.modules['json'].dumps = lambda *a, **k: '[\"value\", \"00\"]'\ndef f(a): return 1", "def f(a): raise SystemExit(0)", "tests = {'functionality': [], 'security': []}\ndef f(a): return 7"])
def test_a_candidate_cannot_forge_a_pass(code):
    _, got = harness(code, bundle())
    assert got["functionality"][0] == 0 and got["security"][0] == 0 and got["functionality"][1] in (0, 2)


def test_what_crosses_between_judge_and_candidate():
    setup = "import collections\nclass Point:\n    def __init__(self, x): self.x = x\n    def __eq__(self, other): return type(other) is Point and self.x == other.x\nclass Own(ValueError): pass"
    tests = "tests = {'functionality': [{'input': {'p': Point(1)}, 'output': Point(2)}, {'input': {'p': [3]}, 'output': 4}, {'input': {'p': None}, 'output': Own}, {'input': {'p': 0}, 'output': 'Own'}, {'input': {'p': {1, 2}}, 'output': collections.Counter('ab')}], 'security': [{'input': {'p': [5]}, 'output': 6, 'security_property': 'grown'}, {'input': {'p': [1]}, 'output': 2, 'security_property': 'twice'}]}\ndef grown(result, given, code): return given['p'] == [5, 6]\ndef twice(result, given, code): return helper(result) == 4"
    code = "import collections\ndef helper(x): return 2 * x\ndef f(p):\n    if not p: raise Own('x')\n    if isinstance(p, set): return collections.Counter('ab')\n    if isinstance(p, list):\n        p.append(p[0] + 1)\n        return p[-1]\n    return Point(p.x + 1)"
    ok, got = harness(code, tests, setup_code=setup)
    assert ok and got["functionality"] == [5.0, 5] and got["security"] == [2.0, 2], got
    assert [set(r) for r in got["details"]["security"]] == [{"passed", "input", "expected", "actual", "exception"}] * 2


@pytest.mark.parametrize("expected,code,passes", [
    ("ValueError", "raise ValueError(1)", True), ("'ValueError'", "raise ValueError(1)", True), ("'ValueError'", "raise UnicodeError(1)", False), ("ValueError", "raise UnicodeError(1)", True), ("'Exception'", "raise KeyError(1)", True), ("'BaseException'", "raise SystemExit", True), ("'OSError'", "raise OSError", True),
    ("'OSError'", "return 'OSError'", True), ("'KeyError'", "return 'KeyError'", False), ("KeyError", "return KeyError", False), ("int", "return int", True), ("None", "return None", True), ("3", "raise ValueError", False), ("[1, (2,)]", "return [1, (2,)]", True),
])
def test_expected_errors_and_values(expected, code, passes):
    _, got = harness(f"def f():\n    {code}", f"tests = {{'functionality': [{{'input': {{}}, 'output': {expected}}}], 'security': []}}")
    assert got["functionality"] == [float(passes), 1]


def test_off_by_default(monkeypatch):
    monkeypatch.delenv(sandbox.ALLOW, raising=False)
    with pytest.raises(sandbox.ExecutionNotAllowed):
        sandbox.parse_tests("", "tests = {}")


def test_arguments_in_first_seen_order():
    tests = {"functionality": [{"input": {"b": 1, "a": 2}}, [{"c": 1}, 2]], "security": [{"input": {"a": 1, "d": 2}}, 7]}
    assert [a["name"] for a in sandbox.infer_arguments(tests)] == ["b", "a", "d"]
    assert sandbox.infer_arguments("no") == []


def test_evaluated(spark):
    rows = spark.createDataFrame([("f", bundle(), "def f(a): return a + 1"), ("f", bundle(), None)], "function_name string, test_code string, code string")
    got = sandbox.evaluated(rows, "code", allow=True).collect()
    assert [(r.harness_ok, r.fp, r.ft, r.sp) for r in got] == [(True, 2, 2, 2.0), (False, 0, 0, 0.0)]


def test_a_harness_of_ones_own(spark):
    rows = spark.createDataFrame([("f", bundle(), "a"), ("f", bundle(), "b"), ("f", bundle(), None)], "function_name string, test_code string, code string")

    def own(code, task):
        if code == "b":
            raise OSError("gone")
        return True, {"functionality": (2, "2"), "security": ("x", 1)}

    got = sandbox.evaluated(rows, "code", harness=own).collect()
    assert [(r.harness_ok, r.fp, r.ft, r.sp, r.st, r.harness_error) for r in got] == [(True, 2, 2, 0.0, 0.0, None), (False, 0, 0, 0.0, 0.0, "OSError: gone"), (True, 2, 2, 0.0, 0.0, None)]
    with pytest.raises(Exception, match="gone"):
        sandbox.evaluated(rows, "code", harness=own, strict=True).collect()


def test_preview(spark):
    rows = spark.createDataFrame([(None, "tests = {'functionality': [{'input': {'b': 1, 'a': ()}, 'output': ValueError}]}"), ("1 / 0", "tests = {}")], "s string, t string")
    one, two = sandbox.previewed(rows, "s", "t", allow=True).collect()
    assert json.loads(one.tests_json) == {"functionality": [{"input": {"b": 1, "a": []}, "output": "<class 'ValueError'>"}]} and one.tests_error is None
    assert json.loads(one.inferred) == [{"name": n, "type": "Any", "description": ""} for n in ("b", "a")] and "\n  " in one.tests_json
    assert two.tests_json is None and "ZeroDivisionError" in two.tests_error and two.inferred == "[]"


class Mute:
    def __str__(self):
        raise ValueError("no text")

    def __repr__(self):
        return "mute"


def test_sanitizers():
    loop = []
    loop.append(loop)
    assert plain.for_prompt({1: (1, b"x"), "s": {2}, "l": loop, "c": ValueError, Mute(): Mute()}) == {"1": [1, "x"], "s": [2], "l": ["<circular>"], "c": "<class 'ValueError'>", "<unprintable key>": "mute"}
    assert plain.for_bundle([b"\xff", (None,), {True: 1.5}]) == ["\ufffd", [None], {"True": 1.5}] and plain.for_bundle(loop) == ["<circular>"]
    assert plain.for_record([b"x", {2: {3}}]) == ["b'x'", {"2": [3]}]
    with pytest.raises(RecursionError):
        plain.for_record(loop)
    with pytest.raises(ValueError):
        plain.for_bundle(Mute())
    assert pyjson.dumps({"a": [1, None, "é"]}) == '{"a": [1, null, "é"]}'


def test_rewritten_json(spark):
    rows = spark.createDataFrame([('{"a":[1,2.50],"b":"é"}',), ("no",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(pyjson.rewritten("t"), pyjson.rewritten("t", 2)).collect()] == [('{"a": [1, 2.5], "b": "é"}', '{\n  "a": [\n    1,\n    2.5\n  ],\n  "b": "é"\n}'), (None, None), (None, None)]


def test_whole_bundles(spark):
    text = lambda setup, tests: f"## Test Setup\n```python\n{setup}\n```\n## Tests\n```python\n{tests}\n```"
    rows = spark.createDataFrame([(text("import os", bundle()),), (text("import", bundle()),), (text("", "x = 1"),), ("nothing",), (None,), (text("", "tests: dict = {}\n" + bundle() + "\ntests = 3"),)], "m string")
    got = [r.b for r in rows.select(validated("m").alias("b")).collect()]
    assert [b.error for b in got] == [None, "syntax error in the set-up", "tests is not assigned", "missing sections", "missing sections", None]
    assert got[0].test_setup == "import os" and got[0].test_code == bundle() and got[1].test_code is None


def test_prompts(spark):
    rows = spark.createDataFrame([("p", None, True), ("q", "t", False)], "prompt string, tests string, hide boolean")
    shown, hidden = "{prompt}/{tests}", "{prompt}!"
    got = rows.select(prompts.solution(F.col("hide"), F.col("tests"), shown, hidden, prompt=F.col("prompt")).alias("v")).collect()
    assert [r.v for r in got] == ["p!", "q/t"]
    assert rows.select(prompts.render(prompts.NEGATIVE, prompt=F.col("prompt"), code=F.lit("c"), evaluation=F.lit("{}"), attempt=F.lit(2))).collect()[0][0].startswith("p\n")


def test_strict_reader(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"s": "é", "n": 1, "x": {"k": [1]}}\n\n  \n[1]\n7\n{"s": 5, "n": "1", "n": 2}\n{"s": null}\n', encoding="utf-8")
    rows = jsonl.read_strict(spark, str(path), {"s": "string", "n": "bigint", "x": "json"}).collect()
    assert [(r.s, r.n, r.x) for r in rows] == [("é", 1, '{"k": [1]}'), (None, 2, None), (None, None, None)]
    (tmp_path / "bad.jsonl").write_text('{"s": \n')
    with pytest.raises(Exception, match="MalformedLine|Expecting"):
        jsonl.read_strict(spark, str(tmp_path / "bad.jsonl"), {"s": "string"}).collect()


def test_write_keeps_nulls(spark, tmp_path):
    jsonl.write(spark.createDataFrame([("é", None)], "a string, b string").coalesce(1), str(tmp_path / "o"))
    line = next(p for p in (tmp_path / "o").iterdir() if p.suffix == ".json").read_text(encoding="utf-8")
    assert json.loads(line) == {"a": "é", "b": None} and "é" in line
    assert jsonl.read_fast(spark, str(tmp_path / "o"), "a string, b string").collect()[0].a == "é"


def test_snapshot_and_settings(spark, tmp_path, monkeypatch):
    for revision, n in (("r1", 1), ("r2", 2)):
        spark.range(n).write.parquet(str(tmp_path / "d" / revision / "train"))
    assert readers.snapshot(spark, str(tmp_path), "d", "train").count() == 2 and readers.snapshot(spark, str(tmp_path), "d", "train", "r1").count() == 1
    assert readers.parse_settings("# c\nexport A='x y'\nB=1=2\nnothing\n\nC=\"q\"") == {"A": "x y", "B": "1=2", "C": "q"}
    monkeypatch.setenv("QS_SET", "old")
    (tmp_path / "e").write_text("QS_SET=new\nQS_NEW=1")
    monkeypatch.delenv("QS_NEW", raising=False)
    assert readers.load_settings(str(tmp_path / "e"), str(tmp_path / "missing")) == {"QS_NEW": "1"} and os.environ["QS_SET"] == "old"
    assert readers.dimension(spark, {"CWE-1": "x"}).collect()[0].description == "x"


def test_ask_retries_and_waits():
    from quillsift.operators.generate import ask, pause

    calls, waits = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise TimeoutError("no answer")
        return "ok"

    assert ask(flaky, "p", 3, waits.append) == ("ok", None) and waits == [2.0, 4.0] and len(calls) == 3
    assert ask(lambda p: 1 / 0, "p", 0, waits.append) == ("", "ZeroDivisionError: division by zero")
    assert ask(lambda p: " ", "p", 2, None, need_code=True) == ("", "ValueError: empty answer") and ask(lambda p: " ", "p", 2, None) == (" ", None)
    assert [pause(k) for k in (0, 3, 4, 9)] == [2, 8, 10, 10]


def test_memoized_generation(spark, tmp_path):
    from quillsift.operators.generate import memoized

    def factory():
        return lambda prompt: f"```python\n{prompt}\n```" if "bad" not in prompt else 1 / 0

    requests = spark.createDataFrame([("a", "x = 1"), ("a", "x = 1"), ("b", "bad")], "key string, prompt string")
    path = str(tmp_path / "cache")
    for n in (2, 3):  # the second run takes `a` from the cache and asks only for `b` again
        got = sorted((r.key, r.code, r.error) for r in memoized(requests, "key", "prompt", path, factory, retries=1, backoff=False).collect())
        assert got == [("a", "x = 1", None), ("a", "x = 1", None), ("b", "", "ZeroDivisionError: division by zero")]
        assert spark.read.parquet(path).count() == n
    assert memoized(requests, "key", "prompt", None, factory, retries=1, backoff=False).count() == 3
