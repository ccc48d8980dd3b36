"""Prompts as text templates over columns. Pass your own templates to keep the keys of an existing cache."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SOLUTION = "Solve the task below in Python.\n\n{prompt}\n\nDefine `{function_name}`.\nArguments: {arguments}\nReturn value: {returned}\nRaises: {raises}\nCode that runs first:\n{setup_code}\n\nAnswer with one fenced code block.\n"
SOLUTION_WITH_TESTS = SOLUTION + "\nThe answer is tested with:\n{tests}\n\nIf the tests contradict the task, answer REJECT.\n"
REVISION = "{prompt}\n\nA first answer was:\n```python\n{code}\n```\n\nIts evaluation was:\n{evaluation}\n\nRewrite it so that every case passes. Answer with one fenced code block.\n"
NEGATIVE = "{prompt}\n\nA trusted answer is:\n```python\n{code}\n```\n\nIts evaluation was:\n{evaluation}\n\nAttempt {attempt}: keep its behavior, but leave out its protection. Answer with one fenced code block.\n"


def render(template: str, **columns: Column) -> Column:
    """The template with {names} replaced by columns; NULL counts as the empty text."""
    parts: list[Column] = []
    for k, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if k % 2:
            parts.append(F.coalesce(columns[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def solution(hide_tests: Column, tests: Column, shown: str = SOLUTION_WITH_TESTS, hidden: str = SOLUTION, **columns: Column) -> Column:
    """The prompt of a first generation; categories on the list do not see the tests."""
    return F.when(hide_tests, render(hidden, **columns)).otherwise(render(shown, tests=tests, **columns))
