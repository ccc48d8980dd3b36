"""Task rows: one flat shape out of flat and nested rows, test cases, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.functions.text import chat_or_text, first_text, flatten_chat, fragment, nonblank, pystrip

# Categories whose prompt hides the tests (fixed values).
HIDDEN_TESTS = ("CWE-78", "CWE-79", "CWE-200", "CWE-352", "CWE-601")
# Fields that may hold a reference, in order (fixed values).
ORIGINALS = ("generated_code", "ground_truth_solution", "fixed_code", "reference_code")
CASE = "struct<input:string,output:string,security_property:string>"


def _has(schema: T.StructType, path: str) -> bool:
    kind: T.DataType = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def field(rows: DataFrame, path: str, text: bool = True) -> Column:
    """A nested field, or NULL where the table has no such field or it is no text."""
    if not _has(rows.schema, path):
        return F.lit(None).cast("string")
    kind: T.DataType = rows.schema
    for name in path.split("."):
        kind = kind[name].dataType
    if text and not isinstance(kind, T.StringType):
        return F.lit(None).cast("string")
    return F.col(path)


def bundle(rows: DataFrame) -> Column:
    """struct(function_name, test_code, setup_tests, setup_code) of the nested shape; NULL unless
    both the name and the test code hold text. Only the name is stripped."""
    at = "reward_model.ground_truth."
    name, code = field(rows, at + "function_name"), field(rows, at + "test_code")
    made = F.struct(
        pystrip(name).alias("function_name"), code.alias("test_code"), F.coalesce(field(rows, at + "setup_tests"), F.lit("")).alias("setup_tests"), F.coalesce(field(rows, at + "setup_code"), F.lit("")).alias("setup_code")
    )
    return F.when(nonblank(name) & nonblank(code), made)


def normalize(rows: DataFrame) -> DataFrame:
    """Adds the flat columns task_* to rows of either shape.

    A nested row takes everything from its bundle: an empty return and raises become the
    empty text and its category comes from extra_info only. A flat row keeps its columns.
    """
    nested = bundle(rows)
    is_nested = nested.isNotNull()
    prompt_kind = rows.schema["prompt"].dataType if "prompt" in rows.columns else T.StringType()
    if isinstance(prompt_kind, T.ArrayType):
        content = prompt_kind.elementType["content"].dataType
        prompt = flatten_chat("prompt", structured=not isinstance(content, T.StringType))
    else:
        prompt = chat_or_text(field(rows, "prompt"))
    returned = field(rows, "return_value") if "return_value" in rows.columns else field(rows, "return")
    pick = lambda name: F.when(is_nested, nested[name]).otherwise(field(rows, name))
    return rows.withColumns(
        {
            "task_function_name": pick("function_name"), "task_test_code": pick("test_code"), "task_setup_tests": pick("setup_tests"), "task_setup_code": pick("setup_code"), "task_prompt": prompt,
            "task_arguments": field(rows, "arguments"), "task_return": F.when(is_nested, F.coalesce(returned, F.lit(""))).otherwise(returned),
            "task_raises": F.when(is_nested, F.coalesce(field(rows, "raises"), F.lit(""))).otherwise(field(rows, "raises")),
            "task_cwe": F.when(is_nested, field(rows, "extra_info.cwe")).otherwise(field(rows, "cwe")), "task_nested": is_nested,
        }
    )


def initial(rows: DataFrame) -> DataFrame:
    """Rows before any generation: no error, no code, no cache hit; old columns of these names are replaced."""
    return rows.withColumns({"mini_gen_error": F.lit(None).cast("string"), "generated_code": F.lit(""), "mini_gen_cache_hit": F.lit(False)})


def arguments(rows: DataFrame) -> Column:
    """The arguments of a normalized and previewed row: its own, or for nested rows without any the inferred ones."""
    own = F.col("task_arguments")
    bare = F.coalesce(F.regexp_replace(own, r"\s", ""), F.lit("")).isin("", "[]", "null", "{}")
    return F.when(F.col("task_nested") & bare, F.col("inferred")).otherwise(own)


def harness_input(rows: DataFrame) -> Column:
    """The four fields a harness needs; set-up parts that are no text count as empty."""
    flat = F.struct(
        field(rows, "function_name").alias("function_name"), field(rows, "test_code").alias("test_code"), F.coalesce(field(rows, "setup_tests"), F.lit("")).alias("setup_tests"), F.coalesce(field(rows, "setup_code"), F.lit("")).alias("setup_code")
    )
    return F.coalesce(bundle(rows), flat)


def reference_code(rows: DataFrame) -> Column:
    """The first reference that is not blank: extra_info, then the row, then the bundle; stripped, else empty."""
    truth = "reward_model.ground_truth."
    places = [*(f"extra_info.{c}" for c in ORIGINALS), *ORIGINALS, "code", *(truth + c for c in (*ORIGINALS, "code"))]
    return first_text(*[field(rows, p) for p in places])


def hides_tests(category: Column | str) -> Column:
    """Whether the prompt of this category leaves the tests out; NULL shows them."""
    c = F.col(category) if isinstance(category, str) else category
    return F.coalesce(c.isin(*HIDDEN_TESTS), F.lit(False))


def gate(name: Column | str, code: Column | str) -> Column:
    """Why a row cannot be generated for: no function name, or no test code; NULL if it can."""
    return F.when(~nonblank(name), F.lit("skipped: missing function_name")).when(~nonblank(code), F.lit("skipped: empty test_code"))


def split_failed(rows: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an error, rows without): costly steps run on the second only."""
    bad = F.col(error).isNotNull() & (F.col(error) != "")
    return rows.where(bad), rows.where(~bad)


def cases(test_code: Column | str) -> Column:
    """The cases of a bundle that is one JSON literal, `tests = {...}`, as struct(functionality, security).

    Texts of any other form give NULL; those need the sandbox. Payloads stay JSON text.
    """
    c = F.col(test_code) if isinstance(test_code, str) else test_code
    body = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^\s*tests\s*=\s*(\{.*\})\s*$", 1)
    return F.from_json(F.nullif(body, F.lit("")), f"struct<functionality:array<{CASE}>,security:array<{CASE}>>")


def unnest(rows: DataFrame, key: str, tests: Column, carry: list[str] | None = None) -> DataFrame:
    """(key, carried columns, category, pos, input, output, security_property): one row for each case.

    A case without input has {}, rows without cases give none. The two categories are
    exploded in one pass.
    """
    tagged = lambda name: F.transform(
        F.coalesce(tests[name], F.array().cast(f"array<{CASE}>")),
        lambda c, k: F.struct(F.lit(name).alias("category"), k.cast("bigint").alias("pos"), F.coalesce(c["input"], F.lit("{}")).alias("input"), c["output"].alias("output"), c["security_property"].alias("security_property")),
    )
    return rows.select(key, *(carry or []), F.explode(F.concat(tagged("functionality"), tagged("security"))).alias("_c")).select(key, *(carry or []), "_c.*")


def input_names(tests: Column) -> Column:
    """Names of the inputs in the order they are first seen, functionality before security."""
    keys = lambda name: F.flatten(F.transform(F.coalesce(tests[name], F.array().cast(f"array<{CASE}>")), lambda c: F.coalesce(F.json_object_keys(c["input"]), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(keys("functionality"), keys("security")))


def property_names(tests: Column) -> Column:
    """Names of the security properties, stripped, distinct and sorted."""
    names = lambda name: F.transform(F.coalesce(tests[name], F.array().cast(f"array<{CASE}>")), lambda c: pystrip(c["security_property"]))
    return F.array_sort(F.array_distinct(F.filter(F.concat(names("functionality"), names("security")), lambda n: n != "")))


def summarize(results: DataFrame, key: str) -> DataFrame:
    """(key, fp, ft, sp, st): passed and total cases by category, from (key, category, ok).

    One hash aggregation; passes are counted before the shuffle.
    """
    inside = lambda name: F.col("category") == name
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return results.groupBy(key).agg(
        F.count_if(inside("functionality") & ok).alias("fp"), F.count_if(inside("functionality")).alias("ft"), F.count_if(inside("security") & ok).cast("double").alias("sp"), F.count_if(inside("security")).cast("double").alias("st")
    )


def details(results: DataFrame, key: str, columns: list[str], separator: str = "|") -> DataFrame:
    """(key, category, details): the cases of each category in their order, as one text."""
    row = F.concat_ws(":", *[fragment(c) for c in columns])
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col("pos"), row.alias("text"))))
    return results.groupBy(key, "category").agg(F.array_join(F.transform(sorted_rows, lambda s: s["text"]), separator).alias("details"))
