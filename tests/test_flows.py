"""The composite flows with a scripted model and our own programs."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quillsift import cli
from quillsift.functions import client, reasons
from quillsift.functions.options import global_batch, supported
from quillsift.operators import reports
from quillsift.plans import flows
from quillsift.session import cut_lineage

DDL = "row_index bigint, function_name string, arguments string, return_value string, raises string, setup_code string, prompt string, setup_tests string, test_code string, cwe string, generated_code string"
TESTS = "tests = {'functionality': [{'input': {'a': 1}, 'output': 2}, {'input': {'a': 2}, 'output': 3}], 'security': [{'input': {'a': 1}, 'output': 2, 'security_property': 'safe'}, {'input': {'a': 0}, 'output': 1}]}\ndef safe(r, i, code): return 'eval' not in code"
GOOD, BAD, WRONG = "def f(a):\n    return a + 1", "def f(a):\n    return eval('a + 1')", "def f(a):\n    return 0"


def row(index, prompt="p", code=GOOD, name="f", tests=TESTS):
    return (index, name, "[]", None, None, None, prompt, None, tests, "CWE-95", code)


def scripted(answers):
    def factory():
        def client(prompt):
            for word, answer in answers:
                if word in prompt:
                    if answer is None:
                        raise TimeoutError("no answer")
                    return f"```python\n{answer}\n```"
            return ""

        return client

    return factory


OPTIONS = {"allow": True, "retries": 1, "backoff": False}


def test_filter_flow_reuses_code(spark):
    rows = spark.createDataFrame([row(0), row(1, code=BAD), row(2, code=" "), row(3, code="def f(:")], DDL)
    whole, kept = flows.filter_flow(rows, "m", None, allow=True)
    got = {r.row_index: (r.mini_gen_error, r.harness_passed) for r in whole.collect()}
    assert got == {0: (None, True), 1: (None, False), 2: ("no generated code", False), 3: (None, False)} and [r.row_index for r in kept.collect()] == [0]
    assert not {"mini_gen_error", "mini_gen_cache_hit", "harness_passed", "harness_result"} & set(kept.columns)


def test_filter_flow_generates(spark, tmp_path):
    rows = spark.createDataFrame([row(0, "task-one"), row(1, "task-two"), row(2, "task-one", name=None), row(3, "task-one", tests=" "), row(4, "task-three")], DDL)
    for hit in (False, True):
        whole, _ = flows.filter_flow(rows, "m", scripted([("task-one", GOOD), ("task-two", BAD), ("task-three", None)]), str(tmp_path / "c"), **OPTIONS)
        got = {r.row_index: (r.mini_gen_error, r.mini_gen_cache_hit, r.harness_passed) for r in whole.collect()}
        assert got == {0: (None, hit, True), 1: (None, hit, False), 2: ("skipped: missing function_name", False, False), 3: ("skipped: empty test_code", False, False), 4: ("TimeoutError: no answer", False, False)}


def test_a_harness_that_fails_ends_the_filter(spark):
    def broken(code, task):
        raise OSError("harness gone")

    with pytest.raises(Exception, match="harness gone"):
        flows.filter_flow(spark.createDataFrame([row(0)], DDL), "m", None, allow=True, harness=broken)[0].collect()
    lax = flows.revision_flow(spark.createDataFrame([row(0)], DDL), "m", scripted([("", GOOD)]), harness=broken, **OPTIONS).collect()[0]
    assert lax.skip_reason == reasons.REVISION_BAD and lax.first.eval.error == "OSError: harness gone"


def test_prompts_show_the_tests_and_inferred_arguments(spark):
    plain = spark.createDataFrame([row(0), (*row(1)[:8], TESTS, "CWE-79", GOOD), row(2, tests="1 / 0")], DDL)
    asked = {r.row_index: r.prompt for r in flows.prepare(plain, allow=True).collect()}
    assert '"security_property": "safe"' in asked[0] and '"input": {\n' in asked[0] and "security_property" not in asked[1] and "no preview: ZeroDivisionError" in asked[2] and "Arguments: []" in asked[0]
    nested = spark.createDataFrame([(0, "p", (("f", TESTS, None, None),))], "row_index bigint, prompt string, reward_model struct<ground_truth:struct<function_name:string,test_code:string,setup_tests:string,setup_code:string>>")
    assert 'Arguments: [{"name": "a", "type": "Any", "description": ""}]' in flows.prepare(nested, allow=True).collect()[0].prompt


def test_revision_flow(spark, tmp_path):
    rows = spark.createDataFrame([row(0, "task-fix"), row(1, "task-well"), row(2, "task-lost"), row(3, "task-mute")], DDL)
    script = [("task-mute", None), ("first answer was", GOOD), ("task-fix", BAD), ("task-well", GOOD), ("task-lost", WRONG)]
    whole = flows.write_both(flows.revision_flow(rows, "m", scripted([("task-lost", WRONG), *script]), str(tmp_path / "c"), **OPTIONS), str(tmp_path / "all"), str(tmp_path / "pairs"))
    made = {r.row_index: r for r in whole.collect()}
    assert {k: r.skip_reason for k, r in made.items()} == {0: None, 1: "first_generation_already_correct_secure", 2: "revision_not_correct_secure", 3: "first_generation_failed: TimeoutError: no answer"}
    assert made[0].dpo.chosen[0].content == f"```python\n{GOOD}\n```" and made[0].dpo.rejected[0].content == f"```python\n{BAD}\n```" and made[1].dpo is None and made[3].first is None
    assert list(made[0].dpo.metadata.asDict()) == ["row_index", "cwe", "function_name", "first_eval", "revision_eval", "pair_rule"] and made[0].dpo.metadata.first_eval.functionality_rate == 1.0
    assert reports.revision_counts(whole).collect()[0].asDict() == {"rows": 4, "pairs": 1, "first_correct_secure": 1, "revision_correct_secure": 1}
    assert [r.row_index for r in spark.read.text(str(tmp_path / "all")).select(F.get_json_object("value", "$.row_index").cast("int").alias("row_index")).collect()] == [0, 1, 2, 3]
    pair = json.loads(spark.read.text(str(tmp_path / "pairs")).collect()[0].value)
    assert pair["metadata"]["pair_rule"] == "first_not_correct_secure_revision_correct_secure" and pair["prompt"][0]["role"] == "user"


def test_negative_flow(spark, tmp_path):
    rows = spark.createDataFrame([row(0, "task-now"), row(1, "task-late"), row(2, "task-never"), row(3, code=BAD), row(4, code=None), row(5, "task-mute")], DDL)
    script = [("task-mute", None), ("task-never", WRONG), ("task-now", BAD), ("Attempt 2", BAD), ("task-late", WRONG)]
    whole = cut_lineage(flows.negative_flow(rows, "m", scripted(script), most=3, cache_path=str(tmp_path / "c"), **OPTIONS))
    made = {r.row_index: r for r in whole.collect()}
    assert {k: (r.skip_reason, len(r.negative_attempts or [])) for k, r in made.items()} == {
        0: (None, 1), 1: (None, 2), 2: ("negative_did_not_match_filter", 3), 3: ("reference_not_correct_secure", 0), 4: ("missing_reference_code", 0), 5: ("negative_generation_failed: TimeoutError: no answer", 3),
    }
    assert made[1].dpo.metadata.negative_attempt == 2 and made[0].dpo.rejected[0].content == f"```python\n{BAD}\n```" and [a.attempt for a in made[2].negative_attempts] == [1, 2, 3]
    assert reports.negative_counts(whole).collect()[0].asDict() == {"rows": 6, "pairs": 2, "reference_correct_secure": 4, "attempts": 6, "functional_insecure": 2}
    assert [r.reason for r in reports.histogram(whole, "skip_reason").collect()] == sorted({"dpo_pair", *(r.skip_reason for r in made.values() if r.skip_reason)})


def test_flows_without_rows(spark):
    rows = spark.createDataFrame([], DDL)
    revised, negative = flows.revision_flow(rows, "m", scripted([]), **OPTIONS), flows.negative_flow(rows, "m", scripted([]), **OPTIONS)
    assert revised.count() == 0 and negative.count() == 0 and reports.negative_counts(negative).collect()[0].attempts == 0


class Endpoint(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Endpoint.seen.append((self.path, self.headers["Authorization"], asked))
        text = "" if "mute" in json.dumps(asked) else f"```python\n{GOOD}\n```"
        answer = {"choices": [{"message": {"content": text}}]} if self.path.endswith("chat/completions") else {"output": [{"content": [{"type": "output_text", "text": text}]}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_client(endpoint, monkeypatch):
    monkeypatch.delenv("NO_KEY", raising=False)
    assert client.http_client("m", base_url=endpoint, api_key_env="NO_KEY")()("hello").startswith("```python")
    assert client.http_client("m", "responses", endpoint, "NO_KEY", max_tokens=7)()("hello").endswith("```")
    with pytest.raises(ValueError, match="empty model response"):
        client.http_client("m", base_url=endpoint)()("mute")
    (path, key, chat), (other, _, responses) = Endpoint.seen[-3:-1]
    assert path == "/v1/chat/completions" and key == "Bearer EMPTY" and chat["messages"][1] == {"role": "user", "content": "hello"} and chat["temperature"] == 0.2
    assert other == "/v1/responses" and responses["max_output_tokens"] == 7 and responses["input"] == "hello"
    monkeypatch.setenv("OPENAI_BASE_URL", "http://here/")
    assert client.endpoint(None) == "http://here" and client.endpoint("x") == "x"
    with pytest.raises(ValueError):
        client.http_client("m", "other")


def test_command_line(spark, tmp_path, endpoint, capsys):
    lines = [{"function_name": "f", "test_code": TESTS, "prompt": [{"role": "user", "content": "task"}], "generated_code": code, "cwe": "CWE-95", "arguments": []} for code in (GOOD, BAD, None)]
    source = tmp_path / "in.jsonl"
    source.write_text("\n".join(["", "[1]", *map(json.dumps, lines)]))
    run = lambda *words: cli.run(spark, cli.parser().parse_args([str(w) for w in words]))
    read = lambda name: [json.loads(r.value) for r in spark.read.text(str(tmp_path / name)).collect()]
    run("filter", "--input-jsonl", source, "--output-jsonl", tmp_path / "kept", "--all-output-jsonl", tmp_path / "whole", "--use-existing-generated-code", "--allow-execution")
    assert [r["row_index"] for r in read("kept")] == [0] and [r["harness_passed"] for r in read("whole")] == [True, False, False]
    run("revise", "--input-jsonl", source, "--max-rows", 2, "--base-url", endpoint, "--dpo-output-jsonl", tmp_path / "d", "--all-output-jsonl", tmp_path / "a", "--allow-execution", "--cache-dir", (tmp_path / "cache").as_uri(), "--max-workers", 1)
    assert len(read("a")) == 2 and {r["skip_reason"] for r in read("a")} == {"first_generation_already_correct_secure"}
    run("negatives", "--input-jsonl", source, "--base-url", endpoint, "--dpo-output-jsonl", tmp_path / "n", "--all-output-jsonl", tmp_path / "na", "--allow-execution", "--num-negative-attempts", 2)
    assert [r["skip_reason"] for r in read("na")] == ["negative_did_not_match_filter", "reference_not_correct_secure", "missing_reference_code"] and "functional_insecure" in capsys.readouterr().out
    published = tmp_path / "p.jsonl"
    published.write_text("\n".join(json.dumps({"lang": lang, "original_instruction": f" i{k} ", "fixed_code": "a", "original_code": code, "cwe": "c", "benign": None}) for k, (lang, code) in enumerate([("Python ", "b"), ("java", "b"), ("python", " "), ("python", "c")])))
    run("convert", "--input-jsonl", published, "--output-jsonl", tmp_path / "conv")
    assert sorted(r["prompt"][0]["content"] for r in read("conv")) == ["i0", "i3"] and '"skipped": 1' in capsys.readouterr().out
    run("split", "--input-jsonl", tmp_path / "conv", "--eval-ratio", 0.5, "--train-output-jsonl", tmp_path / "t", "--eval-output-jsonl", tmp_path / "e")
    assert len(read("t")) == 1 and len(read("e")) == 1
    run("split", "--input-jsonl", tmp_path / "conv", "--eval-jsonl", tmp_path / "e", "--train-output-jsonl", tmp_path / "t2", "--eval-output-jsonl", tmp_path / "e2")
    assert len(read("t2")) == 2 and len(read("e2")) == 1
    with pytest.raises(SystemExit):
        run("revise", "--input-jsonl", source, "--dpo-output-jsonl", "x", "--all-output-jsonl", "y", "--require-harness")


def test_options():
    assert global_batch(2, 4, 8) == 64
    assert supported(lambda a, b=1: 0, a=1, b=None, c=3) == {"a": 1}
    with pytest.raises(TypeError):
        global_batch(1, 2)
