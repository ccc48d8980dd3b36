"""Static check of test bundles in Markdown: parsed, never executed."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillsift.functions.text import sections


def _keys(node: ast.Dict) -> dict[str, ast.expr] | None:
    """The entries of a dict literal, or None if a key is no text."""
    out = {}
    for k, v in zip(node.keys, node.values):
        if not isinstance(k, ast.Constant) or not isinstance(k.value, str):
            return None
        out[k.value] = v
    return out


def bundle_error(tests: str | None) -> str | None:
    """Why the source of a bundle is not acceptable, or None.

    Its first plain assignment to `tests` has to be a dict literal with the lists functionality and security,
    each of two or more dict literals with text keys, an `input` that is a dict literal, and
    an `output`. NULL counts as a missing section.
    """
    if tests is None:
        return "missing sections"
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(tests)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "syntax error"
    assigned = [n.value for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name) and t.id == "tests"]
    if not assigned:
        return "tests is not assigned"
    value = assigned[0]
    if not isinstance(value, ast.Dict) or (groups := _keys(value)) is None:
        return "tests is no dict literal"
    for name in ("functionality", "security"):
        if name not in groups:
            return f"{name} is missing"
        if not isinstance(groups[name], ast.List):
            return f"{name} is no list"
        if len(groups[name].elts) < 2:
            return f"{name} has fewer than two cases"
        for case in groups[name].elts:
            if not isinstance(case, ast.Dict) or (entries := _keys(case)) is None:
                return f"{name} has a case that is no dict literal"
            if "input" not in entries or "output" not in entries:
                return f"{name} has a case without input or output"
            if not isinstance(entries["input"], ast.Dict):
                return f"{name} has an input that is no dict literal"
    return None


@F.pandas_udf(StringType())
def bundle_problem(tests: pd.Series) -> pd.Series:
    """`bundle_error` over a column; NULL means acceptable."""
    return tests.map(lambda t: bundle_error(None if t is None or t != t else t))


def _parses(source: str | None) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


@F.pandas_udf(StringType())
def _whole_problem(setup: pd.Series, tests: pd.Series) -> pd.Series:
    return pd.Series(["syntax error in the set-up" if t is not None and not _parses(s) else bundle_error(t) for s, t in zip(setup, tests)], dtype=object)


def validated(markdown: Column | str) -> Column:
    """struct(test_setup, test_code, error) of a bundle in Markdown: sections, both parses, the
    check of `tests`. The two parts are NULL where there is an error."""
    parts = sections(markdown)
    error = _whole_problem(parts["setup"], parts["tests"])
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(parts["setup"]).alias("test_setup"), good(parts["tests"]).alias("test_code"), error.alias("error"))
