"""Relational operators on small tables, with NULLs, ties, repetitions and empty inputs."""

import pytest
from pyspark.sql import functions as F

from quillsift.functions import scoring
from quillsift.operators import attempts, cache, order, prefs, reports, tasks

TRUTH = [  # summary_ok, fp, ft, sp, st -> correct, secure, negative
    (True, "3", "3", "2.0", "2", True, True, False), (True, "3", "3", "1.0", "2", True, False, True), (True, "2", "3", "2.0", "2", False, True, False),
    (True, "3", "3", "1.9999995", "2", True, True, False), (True, "3", "3", "0.0", "0", True, False, True), (True, "0", "0", "0.0", "0", False, False, False),
    (False, "3", "3", "1.0", "2", False, False, True), (True, "x", "3", "2.0", "2", False, True, False), (None, None, "3", "2.0", "2", False, False, False),
]


def test_score_truth_table(spark):
    rows = spark.createDataFrame([t[:5] for t in TRUTH], "ok boolean, fp string, ft string, sp string, st string")
    scored = rows.select(scoring.score("ok", "fp", "ft", "sp", "st").alias("s"))
    got = scored.select("s.correct", "s.secure", scoring.is_negative(F.col("s.functionality_rate"), F.col("s.security_rate")).alias("n")).collect()
    assert [tuple(r) for r in got] == [t[5:] for t in TRUTH]


def test_full_pass(spark):
    rows = spark.createDataFrame([(True, 3.0, 3.0, 2.0, 2.0), (True, 3.0, 3.0, 1.0, 2.0), (False, 3.0, 3.0, 2.0, 2.0), (True, 0.0, 0.0, 0.0, 0.0), (None, 1.0, 1.0, 1.0, 1.0)], "ok boolean, fp double, ft double, sp double, st double")
    c = F.col
    assert [r[0] for r in rows.select(scoring.passes_fully(c("ok"), c("fp"), c("ft"), c("sp"), c("st"))).collect()] == [True, False, False, False, False]


def source(spark, rows):
    return spark.createDataFrame(rows, "row_index bigint, lang string, cwe string, original_instruction string, original_code string, fixed_code string, benign string")


ROWS = [
    (0, " Python ", "CWE-1", " do ", "bad", "good", "true"), (1, "java", None, "do", "bad", "good", None), (2, None, None, "do", "bad", "good", None),
    (3, "PYTHON", "", " ", "bad", "good", None), (4, "python", "x", "do", None, "good", None), (5, " python", "y", "do", "bad", "good ", "0"), (6, "python", "z", "", "", "", ""),
]


def test_convert(spark):
    got = prefs.convert(source(spark, ROWS), "Python").orderBy("metadata.row_index").collect()
    assert [r.metadata.row_index for r in got] == [0, 5]
    assert got[0].prompt[0].content == "do" and got[1].chosen[0].content == "```python\ngood\n```" and got[0].metadata.lang == " Python "


def test_conversion_stops_at_the_limit(spark):
    seen = prefs.conversion(source(spark, ROWS), "python", 1).collect()
    assert [(r.row_index, r.accepted) for r in seen] == [(0, True)]
    seen = prefs.conversion(source(spark, ROWS), "python", 2).orderBy("row_index").collect()
    assert [(r.row_index, r.accepted) for r in seen] == [(0, True), (3, False), (4, False), (5, True)]
    assert prefs.conversion(source(spark, ROWS), "python", 0).count() == 5
    assert prefs.conversion(source(spark, ROWS), "python", 99).count() == 5


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_ordinal(spark, n):
    rows = spark.range(n).select((F.lit(3 * n) - F.col("id") * 3).alias("id"), F.lit("x").alias("row_index")).repartition(5)
    got = order.with_ordinal(rows, "id").orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(n)) and [r.id for r in got] == sorted(r.id for r in got)


def test_ordinal_of_ties_and_nulls(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("a", 1), (None, 1)], "k string, v int")
    assert sorted(r.row_index for r in order.with_ordinal(rows, "k", unique=False).collect()) == [0, 1, 2, 3]
    unique = spark.createDataFrame([("b", "y"), (None, "x"), ("a", "z")], "k string, v string")
    assert [(r.row_index, r.v) for r in order.with_ordinal(unique, "k").orderBy("row_index").collect()] == [(0, "x"), (1, "z"), (2, "y")]


def test_limits(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert [r.k for r in order.pre_limit(rows, "k", 3).collect()] == [0, 1, 2]
    assert order.pre_limit(rows, "k", 0).count() == 10 and order.pre_limit(rows, "k", -1).count() == 10


@pytest.mark.parametrize("n,ratio", [(0, 0.02), (1, 0.02), (1000, 0.02), (1000, 0.5), (30, 1.0)])
def test_exact_split(spark, n, ratio):
    import math

    rows = spark.range(n).withColumnRenamed("id", "k")
    train, held = order.exact_split(rows, "k", ratio)
    a, b = {r.k for r in train.collect()}, {r.k for r in held.collect()}
    assert len(b) == math.ceil(round(n * ratio, 9)) and not a & b and len(a | b) == n
    assert b == {r.k for r in order.exact_split(rows.repartition(7), "k", ratio)[1].collect()}


def test_exact_split_without_ratio(spark):
    rows = spark.range(3).withColumnRenamed("id", "k")
    assert order.exact_split(rows, "k", 0)[1] is None


ATTEMPTS = [("a", 1, False, "r1"), ("a", 2, True, None), ("a", 3, True, None), ("b", 1, False, "r1"), ("b", 2, False, "r2"), ("c", 1, True, None), ("d", 1, None, "n")]


def test_attempts(spark):
    rows = spark.createDataFrame(ATTEMPTS, "k string, attempt int, ok boolean, reason string")
    ok = F.col("ok")
    assert sorted((r.k, r.attempt) for r in attempts.first_match(rows, "k", "attempt", ok).collect()) == [("a", 2), ("c", 1)]
    assert sorted((r.k, r.attempt) for r in attempts.winners(rows, "k", "attempt", ok).collect()) == [("a", 2), ("c", 1)]
    assert sorted((r.k, r.attempt) for r in attempts.made(rows, "k", "attempt", ok).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 1)]
    assert sorted((r.k, r.reason) for r in attempts.last_reason(rows, "k", "attempt", ok, F.col("reason")).collect()) == [("b", "r2"), ("d", "n")]
    assert attempts.expand(rows.select("k").distinct(), 0).count() == 4 and attempts.expand(rows.select("k").distinct(), 3).count() == 12


ENTRIES = [("h", 1, "out", None), ("b", 1, " ", None), ("e", 1, "out", "Error"), ("q", 1, "", "Error"), ("d", 1, "old", None), ("d", 2, "new", None), ("n", 1, None, "Error")]


def test_cache(spark):
    entries = spark.createDataFrame(ENTRIES, "key string, at int, raw_output string, error string")
    newest = cache.latest(entries, "key", "at")
    assert {r.key: r.raw_output for r in newest.collect()}["d"] == "new" and newest.count() == 6
    requests = spark.createDataFrame([(k,) for k in "hbeqdnx"], "key string")
    hits = {r.key: (r.cache_hit, r.cached_at) for r in cache.lookup(requests, newest, "key", cache.usable("raw_output", "error"), ["at"]).collect()}
    assert hits == {"h": (True, 1), "b": (False, None), "e": (False, None), "q": (False, None), "d": (True, 2), "n": (False, None), "x": (False, None)}
    assert {r.key for r in cache.misses(requests, newest, "key", cache.usable("raw_output", "error")).collect()} == set("beqnx")
    strict = {r.key: (r.output, r.error) for r in cache.replay(requests, newest, "key").collect()}
    assert strict["q"] == ("", "Error") and strict["x"] == ("", "no recorded generation") and strict["d"] == ("new", None)
    loose = {r.key: (r.output, r.error) for r in cache.replay(requests, newest, "key", compat_empty_hit=True).collect()}
    assert loose["q"] == ("", None) and loose["n"] == ("", "Error")


def test_reports(spark):
    rows = spark.createDataFrame([(None,), ("",), ("x",), ("x",)], "r string")
    assert {r.reason: r.n for r in reports.histogram(rows, "r").collect()} == {"dpo_pair": 2, "x": 2}
    assert tuple(reports.counts(rows, x=F.col("r") == "x").collect()[0]) == (4, 2)
    assert tuple(reports.counts(rows.limit(0), x=F.col("r") == "x").collect()[0]) == (0, 0)


FLAT = "function_name string, arguments string, return_value string, raises string, setup_code string, prompt string, setup_tests string, test_code string, cwe string, generated_code string"


def test_normalize_flat(spark):
    rows = spark.createDataFrame([("f", "[]", None, "", None, '[{"role":"user","content":" p "}]', None, "t", "CWE-1", "c"), (None, None, None, None, None, None, None, None, None, None)], FLAT)
    a, b = tasks.normalize(rows).collect()
    assert (a.task_function_name, a.task_prompt, a.task_return, a.task_nested) == ("f", "p", None, False) and b.task_prompt == ""
    assert rows.select(tasks.harness_input(rows).alias("h")).collect()[0].h.setup_code == ""


def test_normalize_nested(spark):
    truth = "struct<function_name:string,test_code:string,setup_tests:string,setup_code:string,code:string>"
    ddl = f"prompt array<struct<role:string,content:string>>, reward_model struct<ground_truth:{truth}>, extra_info struct<cwe:string,generated_code:string>, function_name string, cwe string, return_value string"
    rows = spark.createDataFrame(
        [([("user", "p")], ((" g ", " t ", None, "s", "ref"),), ("CWE-9", None), "flat", "CWE-1", None), ([("user", "p")], ((" ", "t", None, None, None),), None, "flat", "CWE-1", None), (None, None, None, None, None, None)], ddl
    )
    a, b, c = tasks.normalize(rows).collect()
    assert (a.task_function_name, a.task_test_code, a.task_setup_tests, a.task_cwe, a.task_return) == ("g", " t ", "", "CWE-9", "")
    assert (b.task_function_name, b.task_cwe, b.task_nested) == ("flat", "CWE-1", False) and c.task_prompt == ""
    assert [r[0] for r in rows.select(tasks.reference_code(rows)).collect()] == ["ref", "", ""]


def test_cases(spark):
    good = 'tests = {"functionality": [{"input": {"b": 1, "a": 2}, "output": 3}, {"input": {"c": 1}}], "security": [{"input": {"a": 0}, "output": null, "security_property": " p "}]}'
    rows = spark.createDataFrame([(1, good), (2, "tests = run()"), (3, None), (4, "")], "k int, t string").withColumn("c", tasks.cases("t"))
    flat = tasks.unnest(rows, "k", F.col("c")).orderBy("category", "pos").collect()
    assert [(r.k, r.category, r.pos, r.output) for r in flat] == [(1, "functionality", 0, "3"), (1, "functionality", 1, None), (1, "security", 0, None)]
    assert rows.where("k = 1").select(tasks.input_names(F.col("c"))).collect()[0][0] == ["b", "a", "c"]
    assert rows.where("k = 1").select(tasks.property_names(F.col("c"))).collect()[0][0] == ["p"]
    assert rows.where("k = 2").select(tasks.input_names(F.col("c"))).collect()[0][0] == []


def test_gate_and_variants(spark):
    rows = spark.createDataFrame([("f", "t", "CWE-79"), (None, "t", "79"), ("f", " ", None)], "n string, t string, c string")
    assert [tuple(r) for r in rows.select(tasks.gate("n", "t"), tasks.hides_tests("c")).collect()] == [(None, True), ("skipped: missing function_name", False), ("skipped: empty test_code", False)]


def test_attempts_are_numbered_over_many_tasks(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(400)] + [("b", 5), ("b", 3), (None, 1), (None, 0)], "k string, at int").repartition(6)
    got = {(r.k, r["at"]): r.attempt for r in attempts.ordered_attempts(rows, "k", "at").collect()}
    assert got == {**{("hot", k): k + 1 for k in range(400)}, ("b", 3): 1, ("b", 5): 2, (None, 0): 1, (None, 1): 2}
    assert attempts.ordered_attempts(rows, "k", "at", 2).count() == 6 and attempts.ordered_attempts(rows.limit(0), "k", "at").count() == 0
