"""Every core query by name, and the SQL each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import prompts, scoring, text
from quillsift.functions.bundles import bundle_problem, validated
from quillsift.functions.pyjson import rewritten
from quillsift.operators import attempts, cache, order, prefs, reports, tasks
from quillsift.plans import pipelines
from quillsift.session import table
from quillsift.sources import jsonl, readers
from quillsift.sources.storage import workspace
from quillsift.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

W = text.SPACE
NL = "chr(10)"


def query(sql: str | None = None):
    """Registers a function as the query of its name, with its SQL if there is one."""

    def put(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return put


# SQL pieces.
def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{W}+|{W}+$', '', 'g')"


def unfenced(x: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({x}, ''), '{text.FENCED}') THEN {strip(f"regexp_extract({x}, '{text.FENCED}', 1)")} ELSE {strip(x)} END"


def fenced(x: str, tag: str = "'python'") -> str:
    return f"'```' || {tag} || {NL} || {strip(x)} || {NL} || '```'"


FILLED = " AND ".join(f"{strip(c)} <> ''" for c in prefs.REQUIRED)
PYTHON = f"lower({strip('lang')}) = 'python'"
NUMBERED = "(SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS row_index FROM source_rows)"


# ---------------------------------------------------------------- conversion of published rows


@query(
    f"SELECT row_index, {strip('original_instruction')} AS prompt, {fenced('fixed_code')} AS chosen, {fenced('original_code')} AS rejected, lang, cwe, benign, "
    f"'published-preferences' AS source, '{prefs.PAIR_RULE}' AS pair_rule FROM {NUMBERED} WHERE {PYTHON} AND {FILLED}"
)
def q_convert_pairs(spark, root):
    keep = text.same_language("lang", "Python") & prefs.required(*prefs.REQUIRED)
    rows = order.with_ordinal(table(spark, root, "source_rows"), "row_id", keep=keep)
    made = prefs.convert(rows, "Python")
    part = lambda c: F.col(c)[0]["content"].alias(c)
    return made.select("metadata.row_index", part("prompt"), part("chosen"), part("rejected"), "metadata.lang", "metadata.cwe", "metadata.benign", "metadata.source", "metadata.pair_rule")


@query(
    f"WITH p AS (SELECT row_id, {FILLED} AS ok FROM source_rows WHERE {PYTHON}), last AS (SELECT max(row_id) AS last FROM (SELECT row_id FROM p WHERE ok ORDER BY row_id LIMIT 500)) "
    "SELECT count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS skipped, max(row_id) AS last_row FROM p, last WHERE row_id <= last"
)
def q_convert_limit(spark, root):
    seen = prefs.conversion(table(spark, root, "source_rows"), "python", 500, "row_id")
    return seen.agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("skipped"), F.max("row_id").alias("last_row"))


@query("SELECT row_id, repo, lang FROM source_rows ORDER BY row_id LIMIT 1000")
def q_prelimit(spark, root):
    return order.pre_limit(table(spark, root, "source_rows").select("row_id", "repo", "lang"), "row_id", 1000)


@query("SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS row_index FROM source_rows")
def q_ordinal(spark, root):
    return order.with_ordinal(table(spark, root, "source_rows").select("row_id"), "row_id")


@query(f"SELECT row_id, lang FROM source_rows WHERE lower({strip('lang')}) = 'javascript'")
def q_lang_filter(spark, root):
    return table(spark, root, "source_rows").where(text.same_language("lang", "JavaScript")).select("row_id", "lang")


@query(f"SELECT row_id FROM source_rows WHERE {FILLED}")
def q_required_fields(spark, root):
    return table(spark, root, "source_rows").where(prefs.required(*prefs.REQUIRED)).select("row_id")


@query(f"SELECT lower({strip('lang')}) AS language, count(*) AS rows, count(*) FILTER (WHERE NOT ({FILLED})) AS skipped FROM source_rows GROUP BY 1")
def q_skip_counter(spark, root):
    rows = table(spark, root, "source_rows").withColumn("language", F.lower(text.pystrip("lang")))
    return reports.counts(rows, ["language"], skipped=~prefs.required(*prefs.REQUIRED))


@query("SELECT pref_id, prompt[len(prompt)].content AS prompt, chosen[1].content AS chosen, rejected[1].content AS rejected FROM preference_rows")
def q_pref_projection(spark, root):
    rows = table(spark, root, "preference_rows")
    return rows.select("pref_id", F.element_at("prompt", -1)["content"].alias("prompt"), F.col("chosen")[0]["content"].alias("chosen"), F.col("rejected")[0]["content"].alias("rejected"))


@query(f"SELECT row_id, {strip('lang')} AS lang, {strip('original_instruction')} AS instruction, {strip('fixed_code')} AS code FROM source_rows")
def q_pystrip(spark, root):
    return table(spark, root, "source_rows").select("row_id", text.pystrip("lang").alias("lang"), text.pystrip("original_instruction").alias("instruction"), text.pystrip("fixed_code").alias("code"))


@query(f"SELECT gen_id, {unfenced('raw_output')} AS code FROM generation_cache")
def q_fence_extract(spark, root):
    return table(spark, root, "generation_cache").select("gen_id", text.unfence("raw_output").alias("code"))


@query(f"SELECT row_id, {fenced('fixed_code', f"lower({strip('lang')})")} AS fenced FROM source_rows")
def q_fence_format(spark, root):
    return table(spark, root, "source_rows").select("row_id", text.fence("fixed_code", F.lower(text.pystrip("lang"))).alias("fenced"))


MARKDOWN = f"'## Test Setup' || {NL} || '```python' || {NL} || coalesce(setup_tests, '') || {NL} || '```' || {NL} || '## Tests' || {NL} || '```python' || {NL} || test_code || {NL} || '```'"


def _markdown():
    return F.concat(F.lit("## Test Setup\n```python\n"), F.coalesce("setup_tests", F.lit("")), F.lit("\n```\n## Tests\n```python\n"), F.col("test_code"), F.lit("\n```"))


@query(
    f"WITH m AS (SELECT task_id, coalesce({MARKDOWN}, '') AS md FROM task_rows), f AS (SELECT *, regexp_matches(md, '{text.SECTIONS}') AS found FROM m) "
    f"SELECT task_id, found, CASE WHEN found THEN {strip(f"regexp_extract(md, '{text.SECTIONS}', 1)")} END AS setup, CASE WHEN found THEN {strip(f"regexp_extract(md, '{text.SECTIONS}', 2)")} END AS tests FROM f"
)
def q_md_sections(spark, root):
    return table(spark, root, "task_rows").select("task_id", text.sections(_markdown()).alias("s")).select("task_id", "s.found", "s.setup", "s.tests")


def chat(x: str) -> str:
    return f"array_to_string(list_filter(list_transform({x}, lambda m: {strip('m.content')}), lambda t: t <> ''), {NL} || {NL})"


@query(f"SELECT pref_id, {chat('prompt')} AS prompt, {chat('chosen')} AS chosen FROM preference_rows")
def q_flatten_chat(spark, root):
    return table(spark, root, "preference_rows").select("pref_id", text.flatten_chat("prompt").alias("prompt"), text.flatten_chat("chosen").alias("chosen"))


LISTED = 'from_json(prompt, \'[{"role":"VARCHAR","content":"VARCHAR"}]\')'
TASK_PROMPT = f"CASE WHEN ltrim(prompt) LIKE '[%' THEN {chat(LISTED)} ELSE coalesce(prompt, '') END"


@query(
    f"SELECT task_id, function_name, {TASK_PROMPT} AS prompt, arguments, return_value AS returned, raises, cwe, setup_code, setup_tests, test_code, "
    "coalesce(setup_code, '') AS harness_setup, coalesce(setup_tests, '') AS harness_tests FROM task_rows"
)
def q_task_normalize(spark, root):
    rows = table(spark, root, "task_rows")
    flat = tasks.normalize(rows).withColumn("_h", tasks.harness_input(rows))
    return flat.select(
        "task_id", F.col("task_function_name").alias("function_name"), F.col("task_prompt").alias("prompt"), F.col("task_arguments").alias("arguments"), F.col("task_return").alias("returned"), F.col("task_raises").alias("raises"), F.col("task_cwe").alias("cwe"),
        F.col("task_setup_code").alias("setup_code"), F.col("task_setup_tests").alias("setup_tests"), F.col("task_test_code").alias("test_code"), F.col("_h.setup_code").alias("harness_setup"), F.col("_h.setup_tests").alias("harness_tests"),
    )


# The places of a reference in their order: extra_info, the row, the bundle. Each row fills some of them.
PLACES = {
    "extra_info": {"generated_code": ("row_id % 5 = 0", "fixed_code"), "ground_truth_solution": ("row_id % 7 = 1", "original_code"), "fixed_code": ("row_id % 5 = 1", "original_instruction"), "reference_code": ("row_id % 3 = 2", "repo")},
    "": {"generated_code": ("row_id % 11 = 3", "file_path"), "ground_truth_solution": ("row_id % 4 = 1", "fixed_code"), "fixed_code": ("row_id % 13 = 4", "original_code"), "reference_code": ("row_id % 4 = 2", "lang"), "code": ("row_id % 17 = 5", "repo")},
    "truth": {"generated_code": ("row_id % 19 = 6", "repo"), "ground_truth_solution": ("row_id % 6 = 0", "original_instruction"), "fixed_code": ("row_id % 23 = 7", "repo"), "reference_code": ("row_id % 2 = 0", "file_path"), "code": ("row_id % 29 <> 8", "original_code")},
}
IN_ORDER = [f"CASE WHEN {when} THEN {what} END" for part in PLACES.values() for when, what in part.values()]


@query(f"SELECT row_id, coalesce({', '.join(f"nullif({strip(x)}, '')" for x in IN_ORDER)}, '') AS code FROM source_rows")
def q_ref_coalesce(spark, root):
    rows = table(spark, root, "source_rows")
    filled = lambda part: [F.when(F.expr(when), F.col(what)).alias(name) for name, (when, what) in PLACES[part].items()]
    nested = rows.select("row_id", F.struct(*filled("extra_info")).alias("extra_info"), *filled(""), F.struct(F.struct(*filled("truth")).alias("ground_truth")).alias("reward_model"))
    return nested.select("row_id", tasks.reference_code(nested).alias("code"))


NESTED = f"(task_id % 2 = 0 AND {strip('function_name')} <> '' AND {strip('test_code')} <> '')"


@query(
    f"SELECT task_id, {NESTED} AS nested, CASE WHEN {NESTED} THEN {strip('function_name')} WHEN task_id % 2 = 1 THEN function_name END AS function_name, CASE WHEN {NESTED} OR task_id % 2 = 1 THEN test_code END AS test_code, "
    f"CASE WHEN {NESTED} THEN coalesce(setup_tests, '') WHEN task_id % 2 = 1 THEN setup_tests END AS setup_tests, CASE WHEN {NESTED} THEN coalesce(raises, '') ELSE raises END AS raises, "
    f"CASE WHEN {NESTED} THEN repo ELSE cwe END AS cwe, CASE WHEN {NESTED} OR task_id % 2 = 1 THEN coalesce(setup_code, '') ELSE '' END AS harness_setup FROM task_rows"
)
def q_task_nested(spark, root):
    rows = table(spark, root, "task_rows")
    even = F.col("task_id") % 2 == 0
    of = lambda c: F.when(even, F.col(c)).alias(c)
    ground = ["function_name", "test_code", "setup_tests", "setup_code"]
    mixed = rows.select("task_id", "prompt", "arguments", "return_value", "raises", "cwe", *[F.when(~even, F.col(c)).alias(c) for c in ground], F.struct(F.col("repo").alias("cwe")).alias("extra_info"), F.struct(F.struct(*map(of, ground)).alias("ground_truth")).alias("reward_model"))
    flat = tasks.normalize(mixed).withColumn("_h", tasks.harness_input(mixed))
    return flat.select("task_id", F.col("task_nested").alias("nested"), *[F.col(f"task_{c}").alias(c) for c in ("function_name", "test_code", "setup_tests", "raises", "cwe")], F.col("_h.setup_code").alias("harness_setup"))


@query("SELECT task_id, NULL::VARCHAR AS mini_gen_error, '' AS generated_code, false AS mini_gen_cache_hit FROM task_rows")
def q_initial(spark, root):
    return tasks.initial(table(spark, root, "task_rows")).select("task_id", "mini_gen_error", "generated_code", "mini_gen_cache_hit")


@query("SELECT p.pref_id, coalesce(nullif(p.metadata.cwe, ''), s.cwe) AS cwe FROM preference_rows p LEFT JOIN source_rows s ON p.metadata.row_index = s.row_id")
def q_cwe_coalesce(spark, root):
    p = table(spark, root, "preference_rows").select("pref_id", F.col("metadata.cwe").alias("own"), F.col("metadata.row_index").alias("row_id"))
    s = table(spark, root, "source_rows").select("row_id", "cwe")
    return p.join(s, "row_id", "left").select("pref_id", prefs.category("own", "cwe").alias("cwe"))


GATE = f"CASE WHEN {strip('function_name')} = '' THEN 'skipped: missing function_name' WHEN {strip('test_code')} = '' THEN 'skipped: empty test_code' END"


@query(f"SELECT task_id, {GATE} AS error, CASE WHEN {strip('generated_code')} = '' THEN '' ELSE generated_code END AS reused FROM task_rows")
def q_generation_gate(spark, root):
    reused = F.when(text.nonblank("generated_code"), F.col("generated_code")).otherwise("")
    return table(spark, root, "task_rows").select("task_id", tasks.gate("function_name", "test_code").alias("error"), reused.alias("reused"))


@query("SELECT task_id, cwe, coalesce(cwe IN ('CWE-78', 'CWE-79', 'CWE-200', 'CWE-352', 'CWE-601'), false) AS hidden FROM task_rows")
def q_prompt_variant(spark, root):
    return table(spark, root, "task_rows").select("task_id", "cwe", tasks.hides_tests("cwe").alias("hidden"))


# ---------------------------------------------------------------- keys and the generation cache

QUOTED = "to_json({0})::VARCHAR"


@query(
    f"SELECT task_id, sha256('{{\"model\": ' || {QUOTED.format('model')} || ', \"prompt\": ' || {QUOTED.format('prompt')} || '}}') AS task_key, "
    f"sha256('{{\"api_kind\": \"chat\", \"model\": ' || {QUOTED.format('model')} || ', \"prompt\": ' || {QUOTED.format('prompt')} || ', \"stage\": \"first\"}}') AS stage_key, sha256(prompt) AS prompt_sha256 FROM task_rows"
)
def q_sha_key(spark, root):
    return table(spark, root, "task_rows").select(
        "task_id", text.task_key("model", "prompt").alias("task_key"), text.stage_key(F.lit("chat"), "model", "prompt", F.lit("first")).alias("stage_key"), F.sha2("prompt", 256).alias("prompt_sha256")
    )


LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ingested_at DESC, gen_id DESC) AS rn FROM generation_cache) WHERE rn = 1)"
USABLE = f"({strip('raw_output')} <> '' AND coalesce(error, '') = '')"


def _latest(spark, root):
    return cache.latest(table(spark, root, "generation_cache").select("cache_key", "gen_id", "raw_output", "error", "ingested_at"), "cache_key", "ingested_at", "gen_id")


@query(f"SELECT cache_key, gen_id, raw_output, error FROM {LATEST}")
def q_cache_latest(spark, root):
    return _latest(spark, root).select("cache_key", "gen_id", "raw_output", "error")


def _requests(spark, root):
    return table(spark, root, "generation_cache").select(F.col("gen_id").alias("request"), "cache_key")


@query(f"SELECT g.gen_id AS request, coalesce(l.hit, false) AS cache_hit, CASE WHEN l.hit THEN l.gen_id END AS cached_gen_id FROM generation_cache g LEFT JOIN (SELECT cache_key, gen_id, {USABLE} AS hit FROM {LATEST}) l USING (cache_key)")
def q_cache_hit(spark, root):
    return cache.lookup(_requests(spark, root), _latest(spark, root), "cache_key", cache.usable("raw_output", "error"), ["gen_id"]).select("request", "cache_hit", "cached_gen_id")


@query(f"SELECT gen_id AS request, cache_key FROM generation_cache WHERE cache_key NOT IN (SELECT cache_key FROM {LATEST} WHERE {USABLE})")
def q_cache_miss(spark, root):
    return cache.misses(_requests(spark, root), _latest(spark, root), "cache_key", cache.usable("raw_output", "error")).select("request", "cache_key")


@query(f"SELECT count(*) AS keys, count(*) FILTER (WHERE {USABLE}) AS hits, count(*) FILTER (WHERE raw_output IS NOT NULL) AS compat_hits FROM {LATEST}")
def q_cache_compat(spark, root):
    return _latest(spark, root).agg(F.count("*").alias("keys"), F.count_if(cache.usable("raw_output", "error")).alias("hits"), F.count_if(cache.usable_compat("raw_output")).alias("compat_hits"))


@query(
    f"SELECT g.gen_id AS request, CASE WHEN l.ok THEN l.code ELSE '' END AS code, CASE WHEN l.ok THEN NULL ELSE coalesce(nullif(l.error, ''), 'no recorded generation') END AS error FROM generation_cache g "
    f"LEFT JOIN (SELECT cache_key, {USABLE} AS ok, {unfenced('raw_output')} AS code, error FROM {LATEST}) l USING (cache_key)"
)
def q_replay_generate(spark, root):
    made = cache.replay(_requests(spark, root), _latest(spark, root), "cache_key")
    return made.select("request", text.unfence("output").alias("code"), "error")


# ---------------------------------------------------------------- test cases and scores

CASES = (
    "(SELECT task_id, category, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS pos FROM (SELECT task_id, category, from_json(json_extract(substr(test_code, 9), '$.' || category), '[\"JSON\"]') AS cs "
    "FROM task_rows, (VALUES ('functionality'), ('security')) v(category) WHERE test_code LIKE 'tests = {%'))"
)


def _cases(spark, root):
    return tasks.unnest(table(spark, root, "task_rows"), "task_id", tasks.cases("test_code"))


@query(f"SELECT task_id, category, pos::BIGINT AS pos, coalesce(json_extract(c, '$.input')::VARCHAR, '{{}}') AS input, json_extract_string(c, '$.output') AS output, json_extract_string(c, '$.security_property') AS security_property FROM {CASES}")
def q_case_unnest(spark, root):
    return _cases(spark, root)


@query(
    f"SELECT task_id, string_agg(k, ',' ORDER BY seen) AS names FROM (SELECT task_id, k, min(CASE category WHEN 'functionality' THEN 0 ELSE 1000000 END + pos * 1000 + kp) AS seen FROM "
    f"(SELECT task_id, category, pos, unnest(json_keys(c, '$.input')) AS k, generate_subscripts(json_keys(c, '$.input'), 1) AS kp FROM {CASES}) GROUP BY task_id, k) GROUP BY task_id"
)
def q_first_seen_keys(spark, root):
    names = table(spark, root, "task_rows").select("task_id", tasks.input_names(tasks.cases("test_code")).alias("n"))
    return names.where(F.size("n") > 0).select("task_id", F.array_join("n", ",").alias("names"))


@query(f"SELECT task_id, category, string_agg(json_extract_string(c, '$.output'), '|' ORDER BY pos) AS details FROM {CASES} GROUP BY 1, 2")
def q_details_collect(spark, root):
    return tasks.details(_cases(spark, root), "task_id", ["output"])


PROPERTIES = "replace(test_code, '\"security\": [{\"input\"', '\"security\": [{\"security_property\": \" ' || coalesce(function_name, '') || ' \", \"input\"')"


@query(
    f"SELECT task_id, coalesce(nullif({strip('function_name')}, ''), '') AS names FROM (SELECT *, {PROPERTIES} AS changed FROM task_rows) WHERE changed LIKE '%security_property%'"
)
def q_property_names(spark, root):
    named = F.concat(F.lit('"security": [{"security_property": " '), F.coalesce("function_name", F.lit("")), F.lit(' ", "input"'))
    changed = table(spark, root, "task_rows").withColumn("changed", F.replace("test_code", F.lit('"security": [{"input"'), named)).where(F.col("changed").contains("security_property"))
    return changed.select("task_id", F.array_join(tasks.property_names(tasks.cases("changed")), ",").alias("names"))


# Recorded results of cases: all of a passing task, and the functionality of code that runs but does not pass.
RESULTS = f"(SELECT c.task_id, c.category, t.harness_passed OR (c.category = 'functionality' AND {strip('t.generated_code')} <> '' AND coalesce(t.mini_gen_error, '') = '') AS ok FROM {CASES} c JOIN task_rows t USING (task_id))"
SUMMARY = (
    f"(SELECT task_id, count(*) FILTER (WHERE category = 'functionality' AND ok) AS fp, count(*) FILTER (WHERE category = 'functionality') AS ft, "
    f"(count(*) FILTER (WHERE category = 'security' AND ok))::DOUBLE AS sp, (count(*) FILTER (WHERE category = 'security'))::DOUBLE AS st FROM {RESULTS} GROUP BY 1)"
)
RATES = "CASE WHEN ft > 0 THEN fp / ft ELSE 0.0 END"
SECURE = "CASE WHEN st > 0 THEN sp / st ELSE 0.0 END"


def _summary(spark, root):
    rows = table(spark, root, "task_rows").select("task_id", "test_code", "harness_passed", (text.nonblank("generated_code") & (F.coalesce("mini_gen_error", F.lit("")) == "")).alias("ran"))
    cases = tasks.unnest(rows, "task_id", tasks.cases("test_code"), ["harness_passed", "ran"])
    results = cases.select("task_id", "category", (F.col("harness_passed") | (F.col("category") == "functionality") & F.col("ran")).alias("ok"))
    return tasks.summarize(results, "task_id")


@query(f"SELECT * FROM {SUMMARY}")
def q_case_summary(spark, root):
    return _summary(spark, root)


@query(f"SELECT task_id, round({RATES}, 6)::DOUBLE AS functionality_rate, round({SECURE}, 6)::DOUBLE AS security_rate, ft > 0 AND fp = ft AS correct, st > 0 AND sp + 1e-6 >= st AS secure, ft > 0 AND fp = ft AND st > 0 AND sp + 1e-6 >= st AS correct_secure FROM {SUMMARY}")
def q_score(spark, root):
    scored = _summary(spark, root).withColumn("s", scoring.score(F.lit(True), "fp", "ft", "sp", "st"))
    return scored.select("task_id", F.round("s.functionality_rate", 6).alias("functionality_rate"), F.round("s.security_rate", 6).alias("security_rate"), "s.correct", "s.secure", "s.correct_secure")


@query(f"SELECT task_id FROM {SUMMARY} WHERE ft > 0 AND st > 0 AND fp = ft AND sp + 1e-6 >= st")
def q_full_pass(spark, root):
    c = F.col
    return _summary(spark, root).where(scoring.passes_fully(F.lit(True), c("fp"), c("ft"), c("sp"), c("st"))).select("task_id")


@query(f"SELECT task_id FROM {SUMMARY} WHERE {RATES} + 1e-9 >= 1.0 AND {SECURE} < 0.999999")
def q_negative_filter(spark, root):
    scored = _summary(spark, root).withColumn("s", scoring.score(F.lit(True), "fp", "ft", "sp", "st"))
    return scored.where(scoring.is_negative(F.col("s.functionality_rate"), F.col("s.security_rate"))).select("task_id")


@query("SELECT t.task_id, d.description AS checker, d.cwe IS NOT NULL AS known FROM task_rows t LEFT JOIN cwe_dim d ON nullif(ltrim(regexp_extract(t.cwe, '\\d+'), '0'), '') = nullif(ltrim(regexp_extract(d.cwe, '\\d+'), '0'), '')")
def q_checker_registry(spark, root):
    number = lambda c: F.nullif(F.regexp_replace(F.regexp_extract(c, r"\d+", 0), "^0+", ""), F.lit(""))
    registry = table(spark, root, "cwe_dim").select(number("cwe").alias("n"), F.col("description").alias("checker"), F.lit(True).alias("known"))
    return table(spark, root, "task_rows").select("task_id", number("cwe").alias("n")).join(registry, "n", "left").select("task_id", "checker", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT task_id, nullif(arguments, '') AS rewritten FROM task_rows")
def q_json_rewritten(spark, root):
    return table(spark, root, "task_rows").select("task_id", rewritten("arguments").alias("rewritten"))


@query(
    f"SELECT task_id, CASE WHEN test_code IS NULL THEN 'missing sections' WHEN test_code NOT LIKE 'tests = {{%' THEN 'tests is not assigned' WHEN json_array_length(substr(test_code, 9), '$.functionality') < 2 THEN 'functionality has fewer than two cases' "
    f"WHEN json_array_length(substr(test_code, 9), '$.security') < 2 THEN 'security has fewer than two cases' END AS error, CASE WHEN error IS NULL THEN {strip('setup_tests')} END AS test_setup, CASE WHEN error IS NULL THEN {strip('test_code')} END AS test_code FROM task_rows"
)
def q_bundle_markdown(spark, root):
    return table(spark, root, "task_rows").select("task_id", validated(_markdown()).alias("b")).select("task_id", "b.error", "b.test_setup", "b.test_code")


def rendered(template: str, **columns: str) -> str:
    """SQL of a prompt template over columns."""
    parts = re.split(r"\{(\w+)\}", template)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return " || ".join(f"coalesce({columns[x]}, '')" if k % 2 else quoted(x) for k, x in enumerate(parts) if k % 2 or x)


SOLUTION = dict(prompt="prompt", function_name="function_name", arguments="arguments", returned="return_value", raises="raises", setup_code="setup_code", tests="test_code")


@query(
    f"SELECT task_id, CASE WHEN coalesce(cwe IN ('CWE-78', 'CWE-79', 'CWE-200', 'CWE-352', 'CWE-601'), false) THEN {rendered(prompts.SOLUTION, **SOLUTION)} ELSE {rendered(prompts.SOLUTION_WITH_TESTS, **SOLUTION)} END AS solution, "
    f"{rendered(prompts.REVISION, prompt='prompt', code='generated_code', evaluation='return_value')} AS revision, {rendered(prompts.NEGATIVE, prompt='prompt', code='generated_code', evaluation='return_value', attempt="'2'")} AS negative FROM task_rows"
)
def q_prompts(spark, root):
    c = F.col
    parts = {name: c(column) for name, column in SOLUTION.items() if name != "tests"}
    render = lambda template, **more: prompts.render(template, prompt=c("prompt"), code=c("generated_code"), evaluation=c("return_value"), **more)
    return table(spark, root, "task_rows").select("task_id", prompts.solution(tasks.hides_tests("cwe"), c("test_code"), **parts).alias("solution"), render(prompts.REVISION).alias("revision"), render(prompts.NEGATIVE, attempt=F.lit(2)).alias("negative"))


@query(
    "SELECT task_id, CASE WHEN coalesce(test_code, '') NOT LIKE 'tests = {%' THEN 'tests is not assigned' WHEN json_array_length(substr(test_code, 9), '$.functionality') < 2 THEN 'functionality has fewer than two cases' "
    "WHEN json_array_length(substr(test_code, 9), '$.security') < 2 THEN 'security has fewer than two cases' END AS problem FROM task_rows"
)
def q_validate_bundle(spark, root):
    return table(spark, root, "task_rows").select("task_id", bundle_problem(text.fragment("test_code")).alias("problem"))


# ---------------------------------------------------------------- attempts and pairs

TRIES = f"(SELECT prompt_sha256, gen_id, raw_output, error, {USABLE} AS ok, row_number() OVER (PARTITION BY prompt_sha256 ORDER BY gen_id) AS attempt FROM generation_cache)"


def _tries(spark, root):
    rows = table(spark, root, "generation_cache").select("prompt_sha256", "gen_id", "raw_output", "error")
    return attempts.ordered_attempts(rows, "prompt_sha256", "gen_id").withColumn("ok", cache.usable("raw_output", "error"))


@query(f"SELECT prompt_sha256, min(attempt)::BIGINT AS attempt FROM {TRIES} WHERE ok GROUP BY 1")
def q_first_attempt(spark, root):
    return attempts.first_match(_tries(spark, root), "prompt_sha256", "attempt", F.col("ok")).withColumn("attempt", F.col("attempt").cast("bigint"))


@query(f"SELECT t.prompt_sha256, t.gen_id, t.attempt::BIGINT AS attempt, t.ok FROM {TRIES} t LEFT JOIN (SELECT prompt_sha256, min(attempt) AS stop FROM {TRIES} WHERE ok GROUP BY 1) e USING (prompt_sha256) WHERE stop IS NULL OR attempt <= stop")
def q_attempt_prefix(spark, root):
    kept = attempts.made(_tries(spark, root), "prompt_sha256", "attempt", F.col("ok"))
    return kept.select("prompt_sha256", "gen_id", F.col("attempt").cast("bigint").alias("attempt"), "ok")


KEYED_TRIES = f"(SELECT cache_key, gen_id, error, {USABLE} AS ok FROM generation_cache)"


@query(f"SELECT cache_key, arg_max(coalesce(error, 'blank output'), gen_id) AS reason FROM {KEYED_TRIES} GROUP BY 1 HAVING NOT bool_or(ok)")
def q_last_reason(spark, root):
    rows = table(spark, root, "generation_cache").select("cache_key", "gen_id", "error", cache.usable("raw_output", "error").alias("ok"))
    return attempts.last_reason(rows, "cache_key", "gen_id", F.col("ok"), F.coalesce("error", F.lit("blank output")))


@query("SELECT task_id, attempt::INTEGER AS attempt FROM task_rows, range(1, 4) r(attempt)")
def q_attempt_expand(spark, root):
    return attempts.expand(table(spark, root, "task_rows").select("task_id"), 3)


KEYED = "(SELECT repo || '|' || coalesce(cwe, '') AS key, * FROM task_rows)"
REFNEG = (
    f"WITH k AS {KEYED}, r AS (SELECT key, min(task_id) AS ref_id FROM k WHERE harness_passed AND {strip('generated_code')} <> '' GROUP BY 1), "
    f"t AS (SELECT key, count(*) AS tries, min(task_id) FILTER (WHERE {strip('generated_code')} <> '' AND generated_code <> 'REJECT') AS attempt FROM k WHERE NOT harness_passed GROUP BY 1), "
    "p AS (SELECT r.key, r.ref_id, a.generated_code AS ref_code, t.attempt, b.generated_code AS rejected, CASE WHEN t.attempt IS NOT NULL THEN NULL WHEN t.tries IS NULL THEN 'no_negative_attempts' ELSE 'negative_did_not_match_filter' END AS outcome "
    "FROM r LEFT JOIN t USING (key) LEFT JOIN k a ON a.task_id = r.ref_id LEFT JOIN k b ON b.task_id = t.attempt)"
)


def _refneg(spark, root):
    rows = table(spark, root, "task_rows").withColumn("key", F.concat("repo", F.lit("|"), F.coalesce("cwe", F.lit(""))))
    good = F.col("harness_passed")
    refs = rows.where(good & text.nonblank("generated_code")).groupBy("key").agg(F.min("task_id").alias("ref_id"), F.min_by("generated_code", "task_id").alias("ref_code"))
    tries = rows.where(~good).select("key", "task_id", F.col("generated_code").alias("code"))
    return pipelines.reference_pairs(refs, tries, "key", "task_id", text.nonblank("code") & (F.col("code") != "REJECT"))


@query(f"{REFNEG} SELECT key, ref_id, attempt, {fenced('ref_code')} AS chosen, {fenced('rejected')} AS rejected FROM p WHERE outcome IS NULL")
def q_refneg_pairs(spark, root):
    kept = _refneg(spark, root).where("outcome IS NULL")
    tag = F.lit("python")
    return kept.select("key", "ref_id", "attempt", text.fence("ref_code", tag).alias("chosen"), text.fence("rejected", tag).alias("rejected"))


@query(f"{REFNEG} SELECT coalesce(outcome, 'dpo_pair') AS reason, count(*) AS n FROM p GROUP BY 1")
def q_skip_histogram(spark, root):
    return reports.histogram(_refneg(spark, root), "outcome")


RISKY = "'eval\\(|os\\.system|pickle\\.loads|SELECT .* WHERE .* = .? ?\\+'"
REVISED = (
    f"(SELECT prompt_sha256, {unfenced('raw_output')} AS code, NOT regexp_matches(coalesce(raw_output, ''), {RISKY}) AS good, NOT {USABLE} AS failed, row_number() OVER (PARTITION BY prompt_sha256 ORDER BY gen_id) AS attempt FROM generation_cache)"
)
ROUNDS = (
    f"(SELECT prompt_sha256, max(code) FILTER (WHERE attempt = 1) AS first, bool_or(good) FILTER (WHERE attempt = 1) AS g1, bool_or(failed) FILTER (WHERE attempt = 1) AS f1, max(code) FILTER (WHERE attempt = 2) AS second, "
    f"bool_or(good) FILTER (WHERE attempt = 2) AS g2, bool_or(failed) FILTER (WHERE attempt = 2) AS f2 FROM {REVISED} GROUP BY 1)"
)


@query(
    f"SELECT prompt_sha256, outcome, CASE WHEN outcome IS NULL THEN second END AS chosen, CASE WHEN outcome IS NULL THEN first END AS rejected FROM (SELECT *, CASE WHEN f1 THEN 'first_generation_failed' WHEN g1 THEN 'first_generation_already_correct_secure' "
    f"WHEN g2 IS NULL OR f2 THEN 'revision_failed' WHEN NOT g2 THEN 'revision_not_correct_secure' END AS outcome FROM {ROUNDS})"
)
def q_revision_pairs(spark, root):
    return _revised(spark, root).select("prompt_sha256", "outcome", "chosen", "rejected")


def _revised(spark, root):
    rows = table(spark, root, "generation_cache").select("prompt_sha256", "gen_id", text.unfence("raw_output").alias("code"), "raw_output", "error")
    good = ~F.coalesce("raw_output", F.lit("")).rlike(RISKY[1:-1])
    return pipelines.revision_pairs(rows, "prompt_sha256", "gen_id", "code", good, ~cache.usable("raw_output", "error"), F.col("prompt_sha256"))


@query(f"SELECT count(*) AS rows, count(*) FILTER (WHERE NOT f1 AND NOT g1 AND g2 AND NOT f2) AS pairs, count(*) FILTER (WHERE g1) AS first_good, count(*) FILTER (WHERE g2) AS second_good FROM {ROUNDS}")
def q_revision_report(spark, root):
    return reports.counts(_revised(spark, root), None, pairs=F.col("outcome").isNull(), first_good=F.col("first_good"), second_good=F.col("second_good"))


@query(f"{REFNEG} SELECT count(*) AS rows, count(*) FILTER (WHERE outcome IS NULL) AS pairs, (SELECT count(*) FROM k JOIN r USING (key) WHERE NOT harness_passed) AS attempts, (SELECT count(*) FROM k JOIN r USING (key) WHERE NOT harness_passed AND {strip('generated_code')} <> '' AND generated_code <> 'REJECT') AS matching FROM p")
def q_negative_report(spark, root):
    rows = table(spark, root, "task_rows").withColumn("key", F.concat("repo", F.lit("|"), F.coalesce("cwe", F.lit(""))))
    whole = _refneg(spark, root)
    tries = rows.where(~F.col("harness_passed")).join(whole.select("key"), "key", "left_semi")
    matching = text.nonblank("generated_code") & (F.col("generated_code") != "REJECT")
    over = reports.counts(tries, None, matching=matching).select(F.col("rows").alias("attempts"), "matching")
    return reports.counts(whole, None, pairs=F.col("outcome").isNull()).crossJoin(over)


@query("SELECT task_id, function_name, prompt, test_code, cwe, repo, model, coalesce(generated_code, '') AS generated_code FROM task_rows WHERE harness_passed")
def q_filter_valid(spark, root):
    rows = table(spark, root, "task_rows").withColumn("generated_code", text.fragment("generated_code"))
    _, kept = pipelines.filter_valid(rows, F.col("harness_passed"), ["mini_gen_error", "mini_gen_cache_hit", "harness_passed"])
    return kept.select("task_id", "function_name", "prompt", "test_code", "cwe", "repo", "model", "generated_code")


@query("SELECT model, count(*) AS rows, count(*) FILTER (WHERE mini_gen_error IS NOT NULL) AS errors, count(*) FILTER (WHERE mini_gen_cache_hit) AS cache_hits, count(*) FILTER (WHERE harness_passed) AS passed FROM task_rows GROUP BY 1")
def q_run_report(spark, root):
    return reports.counts(table(spark, root, "task_rows"), ["model"], errors=F.col("mini_gen_error").isNotNull(), cache_hits=F.col("mini_gen_cache_hit"), passed=F.col("harness_passed"))


@query("SELECT split_name, metadata.pair_rule AS pair_rule, count(*) AS rows, count(metadata.row_index) AS sourced FROM preference_rows GROUP BY 1, 2")
def q_pair_report(spark, root):
    return table(spark, root, "preference_rows").groupBy("split_name", F.col("metadata.pair_rule").alias("pair_rule")).agg(F.count("*").alias("rows"), F.count("metadata.row_index").alias("sourced"))


# ---------------------------------------------------------------- joins, sets, splits, sinks


@query(f"SELECT t.task_id, h.harness_passed, length({strip('t.generated_code')})::BIGINT AS code_length FROM task_rows t JOIN task_rows h USING (task_id)")
def q_slot_merge(spark, root):
    rows = table(spark, root, "task_rows")
    codes = rows.select("task_id", F.length(text.pystrip("generated_code")).cast("bigint").alias("code_length"))
    return codes.join(rows.select("task_id", "harness_passed"), "task_id").select("task_id", "harness_passed", "code_length")


NUMBER = "nullif(ltrim(regexp_extract({0}, '\\d+'), '0'), '')"


@query(f"SELECT s.row_id, d.cwe AS category, d.description FROM source_rows s LEFT JOIN cwe_dim d ON {NUMBER.format('s.cwe')} = {NUMBER.format('d.cwe')}")
def q_dim_join(spark, root):
    number = lambda c: F.nullif(F.regexp_replace(F.regexp_extract(c, r"\d+", 0), "^0+", ""), F.lit(""))
    rows = table(spark, root, "source_rows").select("row_id", number("cwe").alias("n"))
    dim = table(spark, root, "cwe_dim").select(number("cwe").alias("n"), F.col("cwe").alias("category"), "description")
    return rows.join(dim, "n", "left").select("row_id", "category", "description")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_field(spark, root):
    return table(spark, root, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT task_id, false AS evaluated, false AS passed FROM task_rows WHERE coalesce(mini_gen_error, '') <> '' UNION ALL SELECT task_id, true, harness_passed FROM task_rows WHERE coalesce(mini_gen_error, '') = ''")
def q_union_branches(spark, root):
    failed, fine = tasks.split_failed(table(spark, root, "task_rows"), "mini_gen_error")
    skipped = failed.select("task_id", F.lit(False).alias("evaluated"), F.lit(False).alias("passed"))
    return skipped.unionByName(fine.select("task_id", F.lit(True).alias("evaluated"), F.col("harness_passed").alias("passed")))


@query("SELECT pref_id FROM (SELECT pref_id, row_number() OVER (ORDER BY sha256('42' || pref_id::VARCHAR), pref_id) AS r, count(*) OVER () AS n FROM preference_rows) WHERE r <= ceil(round(0.02 * n, 9))")
def q_split_exact(spark, root):
    return order.exact_split(table(spark, root, "preference_rows").select("pref_id"), "pref_id", 0.02)[1]


SIGNATURE = "list_filter(list_transform(string_split(regexp_extract(coalesce(generated_code, ''), 'def \\w+\\(([^()]*)\\)', 1), ','), lambda p: trim(regexp_replace(p, '[:=].*', ''))), lambda p: p <> '')"
INPUTS = f"(SELECT task_id, list(DISTINCT k) AS names FROM (SELECT task_id, unnest(json_keys(c, '$.input')) AS k FROM {CASES}) GROUP BY 1)"


@query(
    f"SELECT task_id, array_to_string(list_sort(list_filter(names, lambda x: list_contains({SIGNATURE}, x))), ',') AS known, array_to_string(list_sort(list_filter(names, lambda x: NOT list_contains({SIGNATURE}, x))), ',') AS missing FROM {INPUTS} JOIN task_rows USING (task_id)"
)
def q_array_setops(spark, root):
    params = F.transform(F.split(F.regexp_extract(F.coalesce("generated_code", F.lit("")), r"def \w+\(([^()]*)\)", 1), ","), lambda p: F.trim(F.regexp_replace(p, "[:=].*", "")))
    rows = table(spark, root, "task_rows").select("task_id", tasks.input_names(tasks.cases("test_code")).alias("names"), params.alias("params")).where(F.size("names") > 0)
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return rows.select("task_id", joined(F.array_intersect("names", "params")).alias("known"), joined(F.array_except("names", "params")).alias("missing"))


@query("SELECT task_id, coalesce(setup_code, '') AS setup_code, coalesce(raises, '') AS raises, greatest(least(length(coalesce(test_code, '')), 4000), 1)::BIGINT AS clamped FROM task_rows")
def q_source_fragment(spark, root):
    return table(spark, root, "task_rows").select("task_id", text.fragment("setup_code").alias("setup_code"), text.fragment("raises").alias("raises"), text.clamp(F.length("test_code"), 1, 4000).cast("bigint").alias("clamped"))


@query("SELECT chosen[1].content AS chosen, rejected[1].content AS rejected, len(prompt)::BIGINT AS messages FROM preference_rows")
def q_jsonl_roundtrip(spark, root):
    from quillsift.sources.readers import preferences

    path = workspace(spark, "preferences")
    jsonl.write(table(spark, root, "preference_rows").select("prompt", "chosen", "rejected", "metadata"), path)
    return preferences(spark, path).select(F.col("chosen")[0]["content"].alias("chosen"), F.col("rejected")[0]["content"].alias("rejected"), F.size("prompt").cast("bigint").alias("messages"))


@query("SELECT row_id, lang, cwe, original_instruction, fixed_code FROM source_rows")
def q_jsonl_strict(spark, root):
    """Objects among blank lines, lists and scalars; only the objects come back."""
    path = workspace(spark, "source")
    rows = table(spark, root, "source_rows").select("row_id", "lang", "cwe", "original_instruction", "fixed_code")
    noise = F.array(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), F.when(F.col("row_id") % 3 == 0, "").when(F.col("row_id") % 3 == 1, "[1, {}]").otherwise(" 7 "))
    rows.select(F.explode(noise).alias("value")).write.text(path)
    return jsonl.read_strict(spark, path, {"row_id": "bigint", "lang": "string", "cwe": "string", "original_instruction": "string", "fixed_code": "string"}, raw=None)


@query("SELECT row_id, repo FROM source_rows WHERE row_id % 2 = 0")
def q_snapshot(spark, root):
    """The newest revision of a dataset, by the source switch."""
    base = workspace(spark, "snapshots")
    rows = table(spark, root, "source_rows").select("row_id", "repo")
    rows.write.parquet(f"{base}/pairs/r1/train")
    rows.where("row_id % 2 = 0").write.parquet(f"{base}/pairs/r2/train")
    return readers.rows_from(spark, None, root=base, dataset="pairs", split="train")


@query(f"SELECT cache_key, gen_id FROM {LATEST}")
def q_cache_put(spark, root):
    """Entries put in two appends; the latest of each key is read."""
    path = workspace(spark, "cache")
    rows = table(spark, root, "generation_cache").select("cache_key", "gen_id", "raw_output", "error", "ingested_at")
    cache.put(rows.where("gen_id % 2 = 0"), path)
    cache.put(rows.where("gen_id % 2 = 1"), path)
    return cache.latest(spark.read.parquet(path), "cache_key", "ingested_at", "gen_id").select("cache_key", "gen_id")


@query("SELECT split_name = 'train' AS train, count(*) AS rows FROM preference_rows GROUP BY 1")
def q_split_file(spark, root):
    """A given evaluation set is taken as it is."""
    rows = table(spark, root, "preference_rows").select("pref_id", "split_name")
    train, held = order.evaluation_split(rows.where("split_name = 'train'"), "pref_id", rows.where("split_name <> 'train'"), 0.02)
    return train.select(F.lit(True).alias("train")).unionByName(held.select(F.lit(False).alias("train"))).groupBy("train").agg(F.count("*").alias("rows"))


@query("SELECT 'all' AS sink, task_id FROM task_rows UNION ALL SELECT 'passing', task_id FROM task_rows WHERE harness_passed")
def q_dual_sink(spark, root):
    whole, passing = workspace(spark, "all"), workspace(spark, "passing")
    rows = table(spark, root, "task_rows")
    rows.write.parquet(whole)
    spark.read.parquet(whole).where("harness_passed").drop("mini_gen_error", "mini_gen_cache_hit", "harness_passed").write.parquet(passing)
    read = lambda name, path: spark.read.parquet(path).select(F.lit(name).alias("sink"), "task_id")
    return read("all", whole).unionByName(read("passing", passing))


# ---------------------------------------------------------------- streams


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_stream_windows(spark, root):
    source = f"{root}/events.parquet"
    counts = ingest.windowed_counts(ingest.stream_of(spark, source), "ts", "1 day", ["event_type"], "2 days", "value")
    path = workspace(spark, "windows")
    ingest.drain_updates(counts, path, workspace(spark, "progress"))
    return ingest.current(spark.read.parquet(path), "window_start", "event_type").withColumn("total", F.round("total", 4))


@query(f"SELECT cache_key, gen_id FROM {LATEST}")
def q_stream_latest(spark, root):
    source = f"{root}/generation_cache.parquet"
    path = workspace(spark, "latest")
    ingest.drain_latest(ingest.stream_of(spark, source), "cache_key", ["ingested_at", "gen_id"], path, workspace(spark, "progress"))
    return cache.latest(spark.read.parquet(path), "cache_key", "ingested_at", "gen_id").select("cache_key", "gen_id")
