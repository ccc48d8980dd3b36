"""Scalar functions against plain Python."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from quillsift.functions import text

SAMPLES = [
    None, "", " ", "\t\n", " a ", " x ", "\x1cy\x1f", "a​", "　z　", "```python\nx = 1\n```", "```py\r\n  y\n```", "```\nbare\n```", "```PYTHON\nbig\n```", "```js\nno\n```",
    "pre ```python\none\n``` mid ```python\ntwo\n``` post", "```python\n```", "``` \x1c\nz```", "```python\nopen", "REJECT", "x" * 20000, "é ```python\nnaïve\n```", "a\nb\n", '"q"\\', "\u0001\u001f",
]
FENCE = re.compile(r"```(?:python|py)?\s*\n(.*?)```", re.S | re.I)


def unfence(s):
    s = s or ""
    m = FENCE.search(s)
    return (m.group(1) if m else s).strip()


def run(spark, column):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(SAMPLES)], "k int, s string")
    return [r["v"] for r in rows.select("k", column.alias("v")).orderBy("k").collect()]


def test_pystrip_is_str_strip(spark):
    assert run(spark, text.pystrip("s")) == [(s or "").strip() for s in SAMPLES]


def test_nonblank(spark):
    assert run(spark, text.nonblank("s")) == [bool((s or "").strip()) for s in SAMPLES]


def test_unfence(spark):
    assert run(spark, text.unfence("s")) == [unfence(s) for s in SAMPLES]


def test_unfence_of_fence_is_strip(spark):
    got = run(spark, text.unfence(text.fence("s", F.lit("python"))))
    assert [g for g, s in zip(got, SAMPLES) if "```" not in (s or "")] == [(s or "").strip() for s in SAMPLES if "```" not in (s or "")]


def test_json_quote_is_json_dumps(spark):
    assert run(spark, text.json_quote("s")) == [json.dumps(s or "", ensure_ascii=False) for s in SAMPLES]


def test_keys(spark):
    want = [hashlib.sha256(json.dumps({"model": "m", "prompt": s or ""}, ensure_ascii=False, sort_keys=True).encode()).hexdigest() for s in SAMPLES]
    assert run(spark, text.task_key(F.lit("m"), "s")) == want
    want = [hashlib.sha256(json.dumps({"api_kind": "chat", "model": "m", "prompt": s or "", "stage": "first"}, ensure_ascii=False, sort_keys=True).encode()).hexdigest() for s in SAMPLES]
    assert run(spark, text.stage_key(F.lit("chat"), F.lit("m"), "s", F.lit("first"))) == want


def test_sections(spark):
    rows = spark.createDataFrame([("## Test Setup\n```python\na = 1\n```\nmore\n## TESTS\n```python\n tests = {} \n```",), ("## tests only",), (None,)], "m string")
    got = [tuple(r["s"]) for r in rows.select(text.sections("m").alias("s")).collect()]
    assert got == [("a = 1", "tests = {}", True), (None, None, False), (None, None, False)]


def test_flatten_chat(spark):
    rows = spark.createDataFrame([([("system", " a "), ("user", None), ("user", " "), ("user", "b")],), ([],), (None,)], "m array<struct<role:string,content:string>>")
    assert [r["v"] for r in rows.select(text.flatten_chat("m").alias("v")).collect()] == ["a\n\nb", "", ""]


def test_chat_or_text(spark):
    rows = spark.createDataFrame([('[{"role": "user", "content": "x"}]',), (" plain",), ("[not json",), (None,)], "p string")
    assert [r["v"] for r in rows.select(text.chat_or_text("p").alias("v")).collect()] == ["x", " plain", "[not json", ""]


def test_coalesces(spark):
    rows = spark.createDataFrame([(None, " ", "c"), ("", "b ", "c"), (None, "", "")], "a string, b string, c string")
    got = rows.select(text.first_text("a", "b", "c").alias("t"), text.first_truthy("a", "b", "c").alias("u")).collect()
    assert [(r.t, r.u) for r in got] == [("c", " "), ("b", "b "), ("", "")]


def test_language_and_clamp(spark):
    rows = spark.createDataFrame([(" Python ", 3), (None, None), ("java", 99)], "l string, n int")
    got = rows.select(text.same_language("l", "PYTHON").alias("s"), text.clamp(F.col("n"), 5, 10).alias("c")).collect()
    assert [(r.s, r.c) for r in got] == [(True, 5), (False, 5), (False, 10)]
