"""Runs programs that come with the data: off unless allowed, judge and candidate in limited processes of their own."""

from __future__ import annotations

import contextlib
import importlib
import inspect
import json
import os
import resource
import secrets
import shutil
import signal
import subprocess
import sys
import tempfile
from collections.abc import Callable
from functools import lru_cache

from quillsift.functions.pyjson import dumps

ALLOW = "QUILLSIFT_ALLOW_EXECUTION"


@lru_cache(maxsize=None)
def _source(name: str) -> str:
    """The text of a module of this package, on disk or in the archive that Spark ships."""
    module = importlib.import_module(f"quillsift.functions.{name}")
    return inspect.getsource(module).replace("from __future__ import annotations", "")


class ExecutionNotAllowed(RuntimeError):
    """Programs from data are not run unless the environment allows it."""


def _limits(seconds: float, megabytes: int) -> None:
    os.setsid()
    resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 1))
    resource.setrlimit(resource.RLIMIT_AS, (megabytes << 20, megabytes << 20))
    resource.setrlimit(resource.RLIMIT_FSIZE, (64 << 20, 64 << 20))
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))


def execute(parts: list[str], name: str | None, code: str, seconds: float, megabytes: int = 1024, allow: bool | None = None) -> dict:
    """Judges a candidate (parts: set-up, candidate, test set-up, tests) and returns the result or {"error": ...}.

    Judge and candidate are two processes with a working folder and a process group of
    their own, and limits on time, memory and file size. The result comes through a pipe
    that is read to its end, so its size never looks like a timeout, and bears a token
    that the candidate does not know. Without a name only the tests are run and returned.
    """
    if not (os.environ.get(ALLOW) == "1" if allow is None else allow):
        raise ExecutionNotAllowed(f"set {ALLOW}=1 or pass allow=True to run programs from the data")
    folder = tempfile.mkdtemp(prefix="quillsift-run-")
    token = secrets.token_hex(16)
    job = {"parts": parts, "name": name, "code": code, "folder": folder, "candidate": _source("candidate"), "token": token}
    judge = subprocess.Popen(
        [sys.executable, "-I", "-c", _source("plain") + _source("judge")], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=folder, env={"PATH": os.environ.get("PATH", "")}, preexec_fn=lambda: _limits(max(1.0, seconds), megabytes),
    )
    try:
        said, _ = judge.communicate(json.dumps(job).encode("utf-8", "replace"), timeout=max(1.0, seconds))
        got = json.loads(said)
        return got if got.pop("token", None) == token else {"error": "the result is not the judge's"}
    except subprocess.TimeoutExpired:
        return {"error": "timeout"}
    except (OSError, ValueError, AttributeError):
        return {"error": f"the program ended with code {judge.poll()}"}
    finally:
        with contextlib.suppress(ProcessLookupError):
            os.killpg(judge.pid, signal.SIGKILL)
        judge.wait()
        shutil.rmtree(folder, ignore_errors=True)


def parse_tests(setup_tests: str | None, test_code: str | None, seconds: float = 2.0, allow: bool | None = None) -> dict:
    """The value of `tests` after running a bundle, JSON-safe, or {"error": ...}."""
    return execute(["", "", setup_tests or "", test_code or ""], None, "", seconds, allow=allow)


def run_harness(code: str | None, task: dict, seconds: float = 10.0, allow: bool | None = None) -> tuple[bool, dict]:
    """(summary_ok, counts): runs a candidate against its bundle.

    Order: set-up code, candidate, test set-up, tests; the set-up code runs in both
    processes. Named properties are looked up in `security_properties` first, then among the
    globals. Results of classes that the candidate itself defines count as failed. Any
    failure to run gives zero counts and the error.
    """
    parts = [task.get("setup_code") or "", code or "", task.get("setup_tests") or "", task.get("test_code") or ""]
    got = execute(parts, task.get("function_name") or "", code or "", seconds, allow=allow)
    if "error" in got:
        return False, {"functionality": [0, 0], "security": [0.0, 0], "error": got["error"]}
    return True, got


def infer_arguments(tests: dict) -> list[dict]:
    """Arguments by the inputs' names in the order first seen; anything unusable gives none."""
    names: dict[str, None] = {}
    for group in ("functionality", "security"):
        for case in tests.get(group) or [] if isinstance(tests, dict) else []:
            given = case.get("input") if isinstance(case, dict) else None
            for name in filter(None, given if isinstance(given, dict) else ()):
                names.setdefault(name)
    return [{"name": n, "type": "Any", "description": ""} for n in names]


Harness = Callable[[str, dict], tuple[bool, dict]]


def evaluated(rows, code: str, seconds: float = 10.0, allow: bool | None = None, strict: bool = False, harness: Harness | None = None):
    """Rows with harness_ok, fp, ft, sp, st, raw_result and harness_error from running column `code`.

    `harness` takes the code and the row's harness fields and gives (ok, result); without
    one the sandbox judges. An error becomes a zero record, or ends the run if `strict`.
    Write the result out before filtering on it.
    """
    import pandas as pd
    from pyspark.sql import types as T

    extra = "harness_ok boolean, fp bigint, ft bigint, sp double, st double, raw_result string, harness_error string"
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(extra).fields])
    added = [f.name for f in T.StructType.fromDDL(extra)]
    judge = harness or (lambda text, task: run_harness(text, task, seconds, allow))

    def number(value, kind):
        try:
            return kind(value)
        except (TypeError, ValueError, OverflowError):
            return None

    def record(text, task):
        try:
            ok, got = judge(text, task)
        except Exception as e:
            if strict:
                raise
            ok, got = False, {"error": f"{type(e).__name__}: {e}"}
        if strict and "error" in got:
            raise RuntimeError(got["error"])
        counts = []
        for name, kind in (("functionality", int), ("security", float)):
            both = [number(x, kind) for x in (list(got.get(name) or ()) + [0, 0])[:2]]
            counts += [kind(0), kind(0)] if None in both else both
        return (bool(ok), *counts, dumps(got), got.get("error"))

    def run(frames):
        for frame in frames:
            made = [record(r[code] or "", {k: v for k, v in r.items() if v is not None}) for r in frame.to_dict("records")]
            yield pd.concat([frame, pd.DataFrame(made, columns=added, index=frame.index)], axis=1)

    return rows.mapInPandas(run, schema)


def previewed(rows, setup_tests: str, test_code: str, seconds: float = 2.0, allow: bool | None = None):
    """Rows with tests_json (the value of `tests` as indented JSON), tests_error and inferred
    (arguments by the inputs' names, as JSON): each bundle is run once, an error leaves its
    text and an empty list."""
    import pandas as pd
    from pyspark.sql import types as T

    added = ["tests_json", "tests_error", "inferred"]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.StringType()) for c in added]])

    def record(row):
        got = parse_tests(row[setup_tests], row[test_code], seconds, allow)
        if "error" in got:
            return None, got["error"], "[]"
        return dumps(got["tests"], indent=2), None, dumps(infer_arguments(got["tests"]))

    def run(frames):
        for frame in frames:
            made = [record(r) for r in frame.to_dict("records")]
            yield pd.concat([frame, pd.DataFrame(made, columns=added, index=frame.index)], axis=1)

    return rows.mapInPandas(run, schema)
