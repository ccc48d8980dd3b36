"""Judges a candidate. Runs as a process of its own, apart from the candidate's.

This process holds the tests; the candidate's process (module `candidate`) holds its code.
A call goes there with its arguments and comes back with a value or the names of an error,
so a candidate sees neither expected values nor verdicts and cannot write the result. Values
come back through a loader that only makes plain data, known library values and instances
of classes that the set-up code defines here as well. Names that the tests do not define
themselves stand for the candidate's.
"""

import contextlib
import io
import json
import os
import pickle
import struct
import subprocess
import sys
import types

# Names of errors that a case can expect (fixed values): any error, and those that must be met by name.
ANY_ERROR = {"Exception", "BaseException"}
NAMED_ERRORS = {"ValueError", "TypeError", "KeyError", "RuntimeError"}
MODULE = "__candidate__"
LIBRARY = {
    "builtins": "int float str bool bytes list dict tuple complex bytearray set frozenset range slice object", "collections": "OrderedDict Counter defaultdict deque", "datetime": "date datetime time timedelta timezone", "decimal": "Decimal", "fractions": "Fraction", "uuid": "UUID", "pathlib": "PurePosixPath PosixPath Path", "copyreg": "_reconstructor", "ipaddress": "IPv4Address IPv6Address",
}


def control(option, value):
    """One prctl call where there is one."""
    with contextlib.suppress(Exception):
        import ctypes

        ctypes.CDLL(None).prctl(option, value)


class NotPlain(Exception):
    """A value of a kind that is not taken from a candidate."""


class Loader(pickle.Unpickler):
    def find_class(self, module, name):
        if name in LIBRARY.get(module, "").split():
            return super().find_class(module, name)
        known = sys.modules[MODULE].__dict__.get(name) if module == MODULE else None
        if not isinstance(known, type):
            raise NotPlain(f"{module}.{name}")
        return known


class Failed(Exception):
    """What a call in the other process raised: the names of the error's classes, the nearest first."""

    def __init__(self, names, text):
        super().__init__(text)
        self.names, self.text = names, text

    def __repr__(self):
        return self.text


class Candidate:
    """The other process, spoken to in frames of a length and a pickle."""

    def __init__(self, job):
        self.child = subprocess.Popen([sys.executable, "-I", "-c", job["candidate"]], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=job["folder"], env={"PATH": os.environ.get("PATH", "")}, preexec_fn=lambda: control(1, 9))  # it ends with this process

    def ask(self, *message):
        data = pickle.dumps(message)
        try:
            self.child.stdin.write(struct.pack("<Q", len(data)) + data)
            self.child.stdin.flush()
            size = struct.unpack("<Q", self.child.stdout.read(8))[0]
            kind, *rest = json.loads(self.child.stdout.read(size))
        except (OSError, ValueError, struct.error):
            raise RuntimeError("the program ended") from None
        if kind == "raised":
            raise Failed(*rest)
        if kind == "opaque":
            raise NotPlain(rest[0])
        return Loader(io.BytesIO(bytes.fromhex(rest[0]))).load() if kind == "value" else rest

    def call(self, name, *args, **named):
        value, *given = self.ask("call", name, args, named)
        for own, theirs in zip([*args, *named.values()], given):  # arguments that the call has changed
            if isinstance(own, (list, dict, set, bytearray)) and type(own) is type(theirs) and own != theirs:
                own.clear()
                own.extend(theirs) if isinstance(own, (list, bytearray)) else own.update(theirs)
        return value


class Names(dict):
    """The tests' namespace; what is missing there is looked up with the candidate."""

    candidate = None

    def __missing__(self, name):
        if self.candidate is None or hasattr(__builtins__, name) or not self.candidate.ask("has", name)[0]:
            raise KeyError(name)
        return lambda *args, **named: self.candidate.call(name, *args, **named)


def wants(expected):
    """(whether a value can pass, which errors pass) for an expected output."""
    if isinstance(expected, type):
        return not issubclass(expected, BaseException), lambda names: expected.__name__ in names
    if isinstance(expected, str):
        return expected not in ANY_ERROR | NAMED_ERRORS, lambda names: expected in ANY_ERROR or names[:1] == [expected]
    return True, lambda names: False


def parts_of(case):
    """(arguments, expected output) of a case in any of its forms."""
    given, expected = {}, None
    if isinstance(case, dict):
        given, expected = case.get("input", given), case.get("output")
    elif isinstance(case, (list, tuple)) and len(case) > 1:
        given, expected = case[:2]
    return given if isinstance(given, dict) else {}, expected


def names_of(error):
    return error.names if isinstance(error, Failed) else [k.__name__ for k in type(error).__mro__]


def holds(case, actual, given, space, code):
    """Whether the case's named property holds; a case without one always does."""
    name = case.get("security_property") if isinstance(case, dict) else None
    if not name:
        return True
    registry = space.get("security_properties")
    check = registry[name] if isinstance(registry, dict) and name in registry else space.get(name)
    return callable(check) and bool(check(actual, given, code))


def judged(case, call, space, code):
    """The record of one case."""
    given, expected = parts_of(case)
    value_passes, error_passes = wants(expected)
    record = {"passed": False, "input": repr(given), "expected": repr(expected), "actual": repr(None), "exception": None}
    try:
        actual = call(**given)
        record["actual"] = repr(actual)
        record["passed"] = value_passes and bool(actual == expected) and holds(case, actual, given, space, code)
    except NotPlain as e:
        record["exception"] = f"opaque result: {e}"
    except BaseException as e:
        record["exception"] = repr(e)
        record["passed"] = error_passes(names_of(e))
    return record


def run(job):
    module = types.ModuleType(MODULE)
    sys.modules[MODULE] = module
    space = Names()
    space["__name__"] = MODULE
    setup, code, *tests_parts = job["parts"]
    if job["name"] is not None:
        candidate = Candidate(job)
        candidate.ask("load", [setup, code])
    exec(compile(setup, "<setup>", "exec"), space)
    module.__dict__.update(space)
    if job["name"] is not None:
        Names.candidate = candidate
        if candidate.ask("has", job["name"])[0]:
            space[job["name"]] = lambda *args, **named: candidate.call(job["name"], *args, **named)
    for part in tests_parts:
        exec(compile(part, "<tests>", "exec"), space)
        module.__dict__.update(space)
    tests = space.get("tests")
    if not isinstance(tests, dict):
        return {"error": "tests is not a dict"}
    if job["name"] is None:
        return {"tests": for_bundle(tests)}  # noqa: F821  the source of module `plain` stands before this one
    call = space.get(job["name"])
    if not callable(call):
        return {"error": f"missing function {job['name']}"}
    out = {"details": {}}
    for group in ("functionality", "security"):
        cases = tests.get(group)
        if isinstance(cases, list):
            records = [judged(case, call, space, job["code"]) for case in cases]
            out["details"][group] = records
            out[group] = [float(sum(r["passed"] for r in records)), len(records)]
        else:
            out[group] = [0.0, 0]
    return out


def main():
    control(4, 0)  # the candidate may not look into this process
    job = json.loads(sys.stdin.buffer.read())
    result = os.fdopen(os.dup(1), "w", encoding="utf-8", errors="replace")
    with open(os.devnull, "w") as sink, contextlib.redirect_stdout(sink), contextlib.redirect_stderr(sink):
        try:
            got = run(job)
        except Failed as e:
            got = {"error": e.text}
        except BaseException as e:
            got = {"error": f"{type(e).__name__}: {e}"}
    json.dump({"token": job["token"], **for_record(got)}, result, ensure_ascii=False)  # noqa: F821
    result.flush()
    os._exit(0)


if __name__ == "__main__":
    main()
