"""Command line: convert, filter, revise, negatives, split. `python -m quillsift.cli COMMAND --help`.

Paths are those of Spark, so they may lie on any file system; outputs are folders of JSON
Lines. Programs from the data run only with --allow-execution or QUILLSIFT_ALLOW_EXECUTION=1.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.functions.client import http_client
from quillsift.operators import order, prefs, reports
from quillsift.plans import flows
from quillsift.session import build_session, cut_lineage
from quillsift.sources import jsonl, readers


def _model(p: argparse.ArgumentParser, temperature: float, workers: int, timeout: float) -> None:
    p.add_argument("--model", default="")
    p.add_argument("--api-kind", choices=("chat", "responses"), default="chat")
    p.add_argument("--base-url")
    p.add_argument("--api-key-env", default="OPENAI_API_KEY")
    p.add_argument("--temperature", type=float, default=temperature)
    p.add_argument("--max-tokens", type=int, default=2048)
    p.add_argument("--max-workers", type=int, default=workers)
    p.add_argument("--retries", type=int, default=3)
    p.add_argument("--request-timeout", type=float, default=timeout)
    p.add_argument("--harness-timeout-s", type=float, default=10.0)
    p.add_argument("--harness", help="module:function that takes (code, row) and gives (ok, result)")
    p.add_argument("--require-harness", action="store_true", help="fail without --harness")
    p.add_argument("--cache-dir")
    p.add_argument("--no-cache-read", action="store_true")
    p.add_argument("--no-cache-write", action="store_true")
    p.add_argument("--allow-execution", action="store_true", default=None)


def _input(p: argparse.ArgumentParser) -> None:
    p.add_argument("--input-jsonl")
    p.add_argument("--root", default="", help="folder of dataset snapshots")
    p.add_argument("--dataset-id")
    p.add_argument("--revision")
    p.add_argument("--split", default="train")
    p.add_argument("--max-rows", type=int, default=-1)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quillsift", description=__doc__)
    top.add_argument("--master")
    top.add_argument("--env-file", action="append", default=[])
    of = top.add_subparsers(dest="command", required=True)
    p = of.add_parser("filter", help="generate or reuse solutions, run them, keep those that pass")
    _input(p)
    _model(p, 0.2, 16, 60.0)
    p.add_argument("--output-jsonl", required=True)
    p.add_argument("--all-output-jsonl")
    p.add_argument("--use-existing-generated-code", action="store_true")
    for name, temperature in (("revise", 0.2), ("negatives", 0.4)):
        p = of.add_parser(name, help="pairs of a first answer and its revision" if name == "revise" else "pairs of a reference and an insecure variant")
        _input(p)
        _model(p, temperature, 4, 120.0)
        p.add_argument("--dpo-output-jsonl", required=True)
        p.add_argument("--all-output-jsonl", required=True)
        if name == "negatives":
            p.add_argument("--num-negative-attempts", type=int, default=1)
            p.add_argument("--min-functionality-rate", type=float, default=1.0)
            p.add_argument("--max-security-rate", type=float, default=0.999999)
    p = of.add_parser("convert", help="published rows of one language to preference pairs")
    _input(p)
    p.add_argument("--language", default="python")
    p.add_argument("--source-name", default="published-preferences")
    p.add_argument("--output-jsonl", required=True)
    p = of.add_parser("split", help="training and evaluation rows of preference pairs")
    p.add_argument("--input-jsonl", required=True)
    p.add_argument("--eval-jsonl")
    p.add_argument("--eval-ratio", type=float, default=0.02)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--train-output-jsonl", required=True)
    p.add_argument("--eval-output-jsonl")
    return top


def _harness(a: argparse.Namespace):
    if not a.harness:
        if a.require_harness:
            raise SystemExit("--require-harness needs --harness")
        return None
    module, _, name = a.harness.partition(":")
    return getattr(importlib.import_module(module), name)


def _rows(spark, a: argparse.Namespace) -> DataFrame:
    rows = flows.read_rows(spark, a.input_jsonl) if a.input_jsonl else order.with_ordinal(readers.snapshot(spark, a.root, a.dataset_id, a.split, a.revision).withColumn("_at", F.monotonically_increasing_id()), "_at", unique=False).drop("_at")
    return rows if a.max_rows <= 0 else rows.where(F.col("row_index") < a.max_rows)


def _options(a: argparse.Namespace) -> dict:
    return {"cache_path": a.cache_dir, "seconds": a.harness_timeout_s, "allow": a.allow_execution, "harness": _harness(a), "retries": a.retries, "concurrency": a.max_workers, "read": not a.no_cache_read, "write": not a.no_cache_write}


def _client(a: argparse.Namespace):
    return http_client(a.model, a.api_kind, a.base_url, a.api_key_env, a.temperature, a.max_tokens, a.request_timeout)


def _told(frame: DataFrame) -> None:
    for row in frame.collect():
        print(flows.report_line(row.asDict()))


def run(spark, a: argparse.Namespace) -> None:
    if a.command == "convert":
        source = spark.read.json(a.input_jsonl) if a.input_jsonl else readers.snapshot(spark, a.root, a.dataset_id, a.split, a.revision)
        rows = order.with_ordinal(cut_lineage(source.withColumn("_at", F.monotonically_increasing_id())), "_at")
        seen = cut_lineage(prefs.conversion(rows, a.language, a.max_rows))
        jsonl.write(prefs.convert(seen.where("accepted"), a.language, a.source_name), a.output_jsonl)
        _told(reports.counts(seen, None, written=F.col("accepted"), skipped=~F.col("accepted")))
    elif a.command == "split":
        rows = readers.preferences(spark, a.input_jsonl).withColumn("_key", F.sha2(F.to_json(F.struct("prompt", "chosen", "rejected")), 256))
        numbered = order.with_ordinal(rows, "_key", unique=False, name="_n")
        held = readers.preferences(spark, a.eval_jsonl) if a.eval_jsonl else None
        train, test = order.evaluation_split(numbered, "_n", held, a.eval_ratio, a.seed)
        jsonl.write(prefs.prune(train), a.train_output_jsonl)
        if test is not None and a.eval_output_jsonl:
            jsonl.write(prefs.prune(test), a.eval_output_jsonl)
    elif a.command == "filter":
        whole, kept = flows.filter_flow(_rows(spark, a), a.model, None if a.use_existing_generated_code else _client(a), **_options(a))
        whole = cut_lineage(whole)
        if a.all_output_jsonl:
            jsonl.write(whole.orderBy("row_index"), a.all_output_jsonl)
        bookkeeping = ["mini_gen_error", "mini_gen_cache_hit", "harness_passed", "harness_result"]
        jsonl.write(whole.where("harness_passed").orderBy("row_index").drop(*bookkeeping), a.output_jsonl)
        _told(reports.counts(whole, None, errors=F.col("mini_gen_error").isNotNull(), cache_hits=F.col("mini_gen_cache_hit"), passed=F.col("harness_passed")))
    else:
        more = {} if a.command == "revise" else {"most": a.num_negative_attempts, "least_functionality": a.min_functionality_rate, "most_security": a.max_security_rate}
        flow = flows.revision_flow if a.command == "revise" else flows.negative_flow
        whole = flows.write_both(flow(_rows(spark, a), a.model, _client(a), api_kind=a.api_kind, **more, **_options(a)), a.all_output_jsonl, a.dpo_output_jsonl)
        _told(reports.histogram(whole, "skip_reason"))
        _told(reports.revision_counts(whole) if a.command == "revise" else reports.negative_counts(whole, a.min_functionality_rate, a.max_security_rate))


def main(words: list[str] | None = None) -> None:
    a = parser().parse_args(words)
    if a.env_file:
        readers.load_settings(*a.env_file)
    run(build_session("quillsift", a.master), a)


if __name__ == "__main__":
    main(sys.argv[1:])
