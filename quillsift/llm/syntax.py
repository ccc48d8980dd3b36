"""Problem 2: source files that do not parse.

Every value goes through its language's lexer and a pushdown stack, which find
unterminated literals, unbalanced delimiters, premature ends and conflict markers.
The stack also reduces each closed group against the language's grammar (modules
`grammar` and `python_grammar`); no parser of the interpreter takes part in the verdict.
"""

from __future__ import annotations

import ast
import sys
import warnings
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.grammar import MARKER, C, Java, JavaScript, SyntaxProblem
from quillsift.llm.python_grammar import Python
from quillsift.llm.values import is_empty, language_name, map_batches
from quillsift.session import spread

LANGUAGES = ("python", "javascript", "java", "c")

@lru_cache(maxsize=None)
def grammar_of(name: str):
    return {"python": Python, "javascript": JavaScript, "java": Java, "c": C}[name]()


def check(text: str, language: str) -> None:
    """Raises SyntaxProblem if the text is no valid file. Nesting has no bound but memory."""
    grammar = grammar_of(language)
    try:
        grammar.check(text)
    except RecursionError:  # templates within templates
        usual = sys.getrecursionlimit()
        sys.setrecursionlimit(usual + 2 * len(text))
        try:
            grammar.check(text)
        finally:
            sys.setrecursionlimit(usual)


def python_problem(text: str) -> SyntaxError | None:
    """The interpreter's own verdict on a Python text, with the place; problem 2 does not use it."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except SyntaxError as e:
        return e
    except (ValueError, RecursionError, MemoryError) as e:
        return SyntaxError(str(e))
    return None


def parses(text: str, language: str) -> bool:
    """Whether the text is a valid file of one of the four languages; kinds of defects do not matter."""
    try:
        check(text, language)
    except SyntaxProblem:
        return False
    return True


def problem_kind(text: str | None, language: str) -> str | None:
    """None if the text is a valid file of the language (or no file at all), else the kind
    of its first problem: marker, literal, delimiter, end or statement.

    An empty value (see `is_empty`) is no file. Unknown languages are not judged.
    """
    if is_empty(text) or language not in LANGUAGES:
        return None
    try:
        check(text, language)
    except SyntaxProblem as e:
        return "marker" if MARKER.search(text) else e.kind
    return None


def unparsable_files(rows: DataFrame, id_column: str, fields: list[str], lang: str | None = None, path: str | None = None, fixed: str = "python", rates: list[str] | None = None) -> DataFrame:
    """One row per file: (row_id, field_name, language, problem), problem NULL if it parses.

    With `rates`, those columns are carried along. NULL and empty values give no row, an
    empty table gives none, repeated rows are judged each.
    """
    keep = list(rates or [])
    picked = spread(rows.select(
        F.col(id_column).cast("bigint").alias("_id"),
        (F.col(lang) if lang else F.lit(fixed)).alias("_lang"),
        (F.col(path) if path else F.lit("")).alias("_path"),
        *[F.col(f).alias(f"_f{k}") for k, f in enumerate(fields)],
        *[F.col(c).cast("string").alias(f"_r{k}") for k, c in enumerate(keep)],
    ))
    only_bad = rates is None

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("row_id", "field_name", "language", "problem", *keep)}
        languages = [language_name(a, b) for a, b in zip(batch["_lang"], batch["_path"])]
        for k, field in enumerate(fields):
            for n, text in enumerate(batch[f"_f{k}"]):
                if text is None or is_empty(text):
                    continue
                kind = problem_kind(text, languages[n])
                if kind is None and only_bad:
                    continue
                out["row_id"].append(batch["_id"][n])
                out["field_name"].append(field)
                out["language"].append(languages[n])
                out["problem"].append(kind)
                for j, c in enumerate(keep):
                    out[c].append(batch[f"_r{j}"][n])
        return out

    schema = "row_id bigint, field_name string, language string, problem string" + "".join(f", {c} string" for c in keep)
    return map_batches(picked, run, schema)


def parse_rates(files: DataFrame, by: list[str]) -> DataFrame:
    """Files, unparsable files and their share for each group; partial sums come first."""
    return files.groupBy(*by).agg(
        F.count("*").alias("files"), F.count("problem").alias("unparsable"), F.round(F.count("problem") / F.count("*"), 6).alias("rate")
    )
