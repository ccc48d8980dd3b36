"""The composite flows with a live model and a harness.

Each costly step (generation, execution) is written to the shared folder before anything
filters on it, runs only on the rows that still need it, and failed rows leave the flow
with a reason instead of stopping it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import prompts, reasons, scoring
from quillsift.functions.sandbox import Harness, evaluated, previewed
from quillsift.functions.text import nonblank, stage_key, task_key, unfence
from quillsift.operators import tasks
from quillsift.operators.generate import Factory, memoized
from quillsift.operators.order import with_ordinal
from quillsift.operators.prefs import category, pair
from quillsift.session import cut_lineage
from quillsift.sources import jsonl

GROUND = ["function_name", "test_code", "setup_tests", "setup_code"]


def prepare(rows: DataFrame, key: str = "row_index", allow: bool | None = None, preview: bool = True) -> DataFrame:
    """key, the harness fields, the category, the prompt, the gate and the reference code.

    With `preview` each bundle is run once: its tests stand in the prompt as JSON (or the
    error in their place), and nested rows without arguments get those that the tests show.
    """
    flat = tasks.normalize(rows)
    if preview:
        flat = cut_lineage(previewed(flat, "task_setup_tests", "task_test_code", allow=allow))
        tests, arguments = F.coalesce("tests_json", F.concat(F.lit("(no preview: "), F.col("tests_error"), F.lit(")"))), tasks.arguments(flat)
    else:
        tests, arguments = F.col("task_test_code"), F.col("task_arguments")
    parts = dict(
        prompt=F.col("task_prompt"), function_name=F.col("task_function_name"), arguments=arguments, returned=F.col("task_return"), raises=F.col("task_raises"), setup_code=F.col("task_setup_code")
    )
    ask = prompts.solution(tasks.hides_tests("task_cwe"), tests, **parts)
    cwe = category("task_cwe", tasks.field(rows, "cwe"), tasks.field(rows, "extra_info.cwe"))
    return flat.select(
        key, *[F.col(f"task_{c}").alias(c) for c in GROUND], cwe.alias("cwe"), ask.alias("prompt"), tasks.gate("task_function_name", "task_test_code").alias("skip"), unfence(tasks.reference_code(rows)).alias("reference_code")
    )


def _run(rows: DataFrame, code: str, seconds: float, allow: bool | None, harness: Harness | None, strict: bool = False) -> DataFrame:
    """Adds `eval`, the evaluation record with the harness's own result, by running column `code`."""
    made = cut_lineage(evaluated(rows, code, seconds, allow, strict, harness))
    score = scoring.score("harness_ok", "fp", "ft", "sp", "st")
    made = made.withColumn("_s", score).withColumn("eval", F.struct("_s.*", F.coalesce("raw_result", F.lit("{}")).alias("raw_result"), F.col("harness_error").alias("error")))
    return made.drop("_s", "harness_ok", "fp", "ft", "sp", "st", "raw_result", "harness_error")


def _ask(rows: DataFrame, model: str, stage: str, prompt: Column, cache_path: str | None, factory: Factory, api_kind: str = "chat", **options) -> DataFrame:
    """Adds raw_output, code and error."""
    keyed = rows.withColumn("_prompt", prompt).withColumn("cache_key", stage_key(F.lit(api_kind), F.lit(model), "_prompt", F.lit(stage)))
    return cut_lineage(memoized(keyed, "cache_key", "_prompt", cache_path, factory, **options).drop("_prompt", "cache_key", "recorded").withColumnRenamed("output", "raw_output"))


def _told(reason: str, error: str = "error") -> Column:
    return F.concat(F.lit(f"{reason}: "), F.col(error))


def filter_flow(rows: DataFrame, model: str, factory: Factory | None, cache_path: str | None = None, key: str = "row_index", seconds: float = 10.0, allow: bool | None = None, harness: Harness | None = None, strict: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """Generate (or reuse `generated_code` if there is no model), evaluate, keep what passes.

    Gives (all rows with their columns, mini_gen_error, mini_gen_cache_hit, harness_passed and
    harness_result; passing rows without the bookkeeping). Rows with an error are not run. A
    harness that fails ends the run if `strict`; code that fails in the sandbox only fails.
    """
    preview = factory is not None
    given = tasks.field(rows, "generated_code").alias("_given")
    ready = prepare(rows, key, allow, preview).join(rows.select(key, given), key)
    if factory is None:
        usable = nonblank("_given")
        made = ready.withColumns({"generated_code": F.when(usable, F.col("_given")).otherwise(""), "mini_gen_error": F.when(~usable, F.lit("no generated code")), "mini_gen_cache_hit": F.lit(False)})
    else:
        skipped, todo = tasks.split_failed(tasks.initial(ready), "skip")
        keyed = todo.withColumn("cache_key", task_key(F.lit(model), "prompt"))
        asked = cut_lineage(memoized(keyed, "cache_key", "prompt", cache_path, factory, need_code=True, **{"backoff": False, **options}))
        asked = asked.withColumns({"generated_code": F.col("code"), "mini_gen_error": F.col("error"), "mini_gen_cache_hit": F.col("recorded")}).drop("cache_key", "output", "code", "error", "recorded")
        made = asked.unionByName(skipped.withColumn("mini_gen_error", F.col("skip")))
    bad, good = tasks.split_failed(made, "mini_gen_error")
    run = _run(good, "generated_code", seconds, allow, harness, strict and harness is not None)
    columns = [key, *GROUND, "cwe", "generated_code", "mini_gen_error", "mini_gen_cache_hit"]
    passed = run.select(*columns, F.col("eval.correct_secure").alias("harness_passed"), F.col("eval.raw_result").alias("harness_result"))
    whole = passed.unionByName(bad.select(*columns, F.lit(False).alias("harness_passed"), F.lit("{}").alias("harness_result")))
    kept = whole.where("harness_passed").drop("mini_gen_error", "mini_gen_cache_hit", "harness_passed", "harness_result")
    return whole, kept


def revision_flow(rows: DataFrame, model: str, factory: Factory, cache_path: str | None = None, key: str = "row_index", seconds: float = 10.0, allow: bool | None = None, harness: Harness | None = None, **options) -> DataFrame:
    """First answer, and one revision where it fails.

    One row for each input row: key, cwe, function_name, prompt, first and revision (raw_output,
    code, eval; NULL where they did not take place), dpo_pair, skip_reason, dpo.
    """
    first = _ask(prepare(rows, key, allow), model, "first", F.col("prompt"), cache_path, factory, **options)
    bad, good = tasks.split_failed(first, "error")
    answer = F.struct("raw_output", "code", "eval")
    tried = _run(good, "code", seconds, allow, harness).withColumn("first", answer).drop("raw_output", "code", "eval", "error")
    fine = F.col("first.eval.correct_secure")
    ask = prompts.render(prompts.REVISION, prompt=F.col("prompt"), code=F.col("first.code"), evaluation=F.to_json("first.eval"))
    second = _ask(tried.where(~fine), model, "revision", ask, cache_path, factory, **options)
    bad2, good2 = tasks.split_failed(second, "error")
    retried = _run(good2, "code", seconds, allow, harness).withColumn("revision", answer)
    better = F.col("revision.eval.correct_secure")
    meta = F.struct(F.col(key), "cwe", "function_name", F.col("first.eval").alias("first_eval"), F.col("revision.eval").alias("revision_eval"), F.lit(reasons.REVISION_RULE).alias("pair_rule"))
    shown = [key, "cwe", "function_name", "prompt"]
    done = retried.select(*shown, "first", "revision", F.when(~better, reasons.REVISION_BAD).alias("skip_reason"), F.when(better, pair(F.col("prompt"), F.col("revision.code"), F.col("first.code"), meta)).alias("dpo"))
    null = lambda name: F.lit(None).cast(done.schema[name].dataType).alias(name)
    out = lambda frame, first, reason: frame.select(*shown, first, null("revision"), reason.alias("skip_reason"), null("dpo"))
    whole = (
        done.unionByName(out(bad, null("first"), _told(reasons.FIRST_FAILED)))
        .unionByName(out(tried.where(fine), F.col("first"), F.lit(reasons.FIRST_GOOD)))
        .unionByName(out(bad2, F.col("first"), _told(reasons.REVISION_FAILED)))
    )
    return whole.withColumn("dpo_pair", F.col("dpo").isNotNull())


def negative_flow(
    rows: DataFrame, model: str, factory: Factory, most: int = 1, least_functionality: float = 1.0, most_security: float = 0.999999, cache_path: str | None = None, key: str = "row_index", seconds: float = 10.0, allow: bool | None = None, harness: Harness | None = None, **options
) -> DataFrame:
    """A trusted reference against the first attempt that works but is insecure.

    One row for each input row: key, cwe, function_name, prompt, reference (code, eval),
    negative_attempts (attempt, raw_output, code, eval, error, in their order), dpo_pair,
    skip_reason, dpo. Every round asks only for rows that have no match yet, so later
    attempts never happen; the last attempt's reason stays.
    """
    ready = prepare(rows, key, allow)
    has = nonblank("reference_code")
    shown = [key, "cwe", "function_name", "prompt"]
    checked = _run(ready.where(has), "reference_code", seconds, allow, harness).withColumn("reference", F.struct(F.col("reference_code").alias("code"), "eval")).drop("eval")
    fine = F.col("reference.eval.correct_secure")
    left = checked.where(fine).select(*dict.fromkeys([*shown, *GROUND]), "reference")
    start = left
    rounds: list[DataFrame] = []
    for attempt in range(1, max(1, most) + 1):
        ask = prompts.render(prompts.NEGATIVE, prompt=F.col("prompt"), code=F.col("reference.code"), evaluation=F.to_json("reference.eval"), attempt=F.lit(attempt))
        asked = _ask(left, model, f"reference_negative_{attempt}", ask, cache_path, factory, **options)
        bad, good = tasks.split_failed(asked, "error")
        run = _run(good, "code", seconds, allow, harness)
        match = scoring.is_negative(F.col("eval.functionality_rate"), F.col("eval.security_rate"), least_functionality, most_security)
        told = run.select(key, F.lit(attempt).alias("attempt"), "raw_output", "code", "eval", F.lit(None).cast("string").alias("error"), match.alias("matches"), F.when(~match, reasons.NEGATIVE_BAD).alias("reason"))
        null = F.lit(None).cast(told.schema["eval"].dataType).alias("eval")
        failed = bad.select(key, F.lit(attempt).alias("attempt"), F.lit(None).cast("string").alias("raw_output"), F.lit(None).cast("string").alias("code"), null, _told(reasons.NEGATIVE_FAILED).alias("error"), F.lit(False).alias("matches"), _told(reasons.NEGATIVE_FAILED).alias("reason"))
        tried = cut_lineage(told.unionByName(failed))
        rounds.append(tried)
        left = left.join(tried.where("matches").select(key), key, "left_anti")
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    record = F.struct("attempt", "raw_output", "code", "eval", "error")
    # At most `most` attempts a row, so the lists are bounded.
    told = every.groupBy(key).agg(
        F.array_sort(F.collect_list(record), lambda a, b: (a["attempt"] - b["attempt"]).cast("int")).alias("negative_attempts"), F.max_by("reason", "attempt").alias("_reason"), F.max(F.struct("matches", "code", "eval", "attempt")).alias("_best")
    )
    joined = start.join(told, key, "left")
    hit = F.coalesce(F.col("_best.matches"), F.lit(False))
    meta = F.struct(F.col(key), "cwe", "function_name", F.col("reference.eval").alias("reference_eval"), F.col("_best.eval").alias("rejected_eval"), F.col("_best.attempt").alias("negative_attempt"), F.lit(reasons.NEGATIVE_RULE).alias("pair_rule"))
    done = joined.select(*shown, "reference", "negative_attempts", F.when(~hit, F.coalesce("_reason", F.lit(reasons.NO_ATTEMPTS))).alias("skip_reason"), F.when(hit, pair(F.col("prompt"), F.col("reference.code"), F.col("_best.code"), meta)).alias("dpo"))
    none = lambda name: F.lit(None).cast(done.schema[name].dataType).alias(name)
    out = lambda frame, reference, reason: frame.select(*shown, reference, none("negative_attempts"), F.lit(reason).alias("skip_reason"), none("dpo"))
    whole = done.unionByName(out(checked.where(~fine), F.col("reference"), reasons.REFERENCE_BAD)).unionByName(out(ready.where(~has), none("reference"), reasons.NO_REFERENCE))
    return whole.withColumn("dpo_pair", F.col("dpo").isNotNull())


def write_both(whole: DataFrame, all_path: str | None, pairs_path: str | None, key: str = "row_index") -> DataFrame:
    """Writes all rows and the pairs alone (their `dpo`), both in the order of the input, and gives the rows as written."""
    kept = cut_lineage(whole)
    if all_path:
        jsonl.write(kept.orderBy(key), all_path)
    if pairs_path:
        jsonl.write(kept.where("dpo_pair and dpo is not null").orderBy(key).select("dpo.*"), pairs_path)
    return kept


def read_rows(spark: SparkSession, path: str, key: str = "row_index") -> DataFrame:
    """Task rows of a JSON Lines file, numbered in the order of the file; blank lines and lines that are no object are left out."""
    lines = jsonl.read_strict(spark, path, {}, raw="raw")
    numbered = lines.withColumn("_at", F.monotonically_increasing_id())
    numbered = with_ordinal(cut_lineage(numbered), "_at", name=key)
    text = "function_name test_code setup_tests setup_code arguments return raises cwe generated_code ground_truth_solution fixed_code reference_code code".split()
    cell = lambda name: F.get_json_object("raw", f"$.{name}")
    truth = F.struct(*[cell(f"reward_model.ground_truth.{c}").alias(c) for c in ("function_name", "test_code", "setup_tests", "setup_code", *tasks.ORIGINALS, "code")])
    extra = F.struct(cell("extra_info.cwe").alias("cwe"), *[cell(f"extra_info.{c}").alias(c) for c in tasks.ORIGINALS])
    return numbered.select(key, cell("prompt").alias("prompt"), *[cell(c).alias(c) for c in text], extra.alias("extra_info"), F.struct(truth.alias("ground_truth")).alias("reward_model"))


def report_line(counts: dict[str, int]) -> str:
    """A run report as one JSON line with sorted keys."""
    return json.dumps(counts, sort_keys=True)
