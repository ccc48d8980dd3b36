"""Scalar text functions as Column builders; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip sees it (fixed values); valid in Java, RE2 and Python patterns alike.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A code block: three back quotes, an optional Python tag, a line end, the body, three back quotes (fixed value).
FENCED = "(?is)```(?:python|py)?" + SPACE + r"*\n(.*?)```"
# The two sections of a test bundle in Markdown (fixed value).
SECTIONS = f"(?is)##{SPACE}*test setup{SPACE}*```python(.*?)```.*?##{SPACE}*tests{SPACE}*```python(.*?)```"


def pystrip(text: Column | str) -> Column:
    """Without outer Unicode white space; NULL becomes the empty text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{SPACE}+|{SPACE}+\\z", "")


def nonblank(text: Column | str) -> Column:
    """Whether anything but white space stands in the text; never NULL."""
    return pystrip(text) != ""


def first_text(*texts: Column | str) -> Column:
    """The first text that is not blank, stripped; the empty text if there is none."""
    return F.coalesce(*[F.nullif(pystrip(t), F.lit("")) for t in texts], F.lit(""))


def first_truthy(*texts: Column | str) -> Column:
    """The first text that is neither NULL nor empty; if there is none, the last one."""
    columns = [F.col(t) if isinstance(t, str) else t for t in texts]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def unfence(text: Column | str) -> Column:
    """The body of the first code block, stripped; without a block the whole text, stripped.

    NULL gives the empty text. An empty block gives the empty text, not the whole.
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(c.rlike(FENCED), pystrip(F.regexp_extract(c, FENCED, 1))).otherwise(pystrip(c))


def fence(code: Column | str, tag: Column | str) -> Column:
    """A code block around stripped code. `tag` is a column; give F.lit for a constant."""
    t = F.col(tag) if isinstance(tag, str) else tag
    return F.concat(F.lit("```"), t, F.lit("\n"), pystrip(code), F.lit("\n```"))


def sections(markdown: Column | str) -> Column:
    """struct(setup, tests, found): the two sections of a bundle, stripped; NULL parts if not found."""
    c = F.coalesce(F.col(markdown) if isinstance(markdown, str) else markdown, F.lit(""))
    found = c.rlike(SECTIONS)
    part = lambda k: F.when(found, pystrip(F.regexp_extract(c, SECTIONS, k)))
    return F.struct(part(1).alias("setup"), part(2).alias("tests"), found.alias("found"))


def flatten_chat(messages: Column | str, structured: bool = False) -> Column:
    """The contents of a message list, stripped, blank ones left out, joined by an empty line.

    NULL lists, NULL messages and NULL contents give nothing. With `structured` the contents
    are no text (parts of several kinds) and count by their JSON.
    """
    c = F.col(messages) if isinstance(messages, str) else messages
    said = (lambda m: F.to_json(m["content"])) if structured else (lambda m: m["content"])
    parts = F.filter(F.transform(F.coalesce(c, F.array()), lambda m: pystrip(said(m))), lambda t: t != "")
    return F.array_join(parts, "\n\n")


def chat_or_text(prompt: Column | str) -> Column:
    """A prompt that is either plain text or a JSON message list, as one text."""
    c = F.col(prompt) if isinstance(prompt, str) else prompt
    listed = F.from_json(c, "array<struct<role:string,content:string>>")
    is_list = F.coalesce(F.ltrim(c).startswith("["), F.lit(False)) & listed.isNotNull()
    return F.when(is_list, flatten_chat(listed)).otherwise(F.coalesce(c, F.lit("")))


def same_language(lang: Column | str, wanted: str) -> Column:
    """Equal after stripping and lower-casing the column; the argument is only lower-cased."""
    return F.lower(pystrip(lang)) == F.lit(wanted.lower())


def fragment(value: Column | str) -> Column:
    """A source fragment as text: NULL is empty, anything else is cast."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(c.cast("string"), F.lit(""))


def clamp(value: Column, low: float | int, high: float | int | None = None) -> Column:
    """At least `low`, at most `high` if given; NULL counts as `low`."""
    at_least = F.greatest(F.coalesce(value, F.lit(low)), F.lit(low))
    return at_least if high is None else F.least(at_least, F.lit(high))


def json_quote(text: Column | str) -> Column:
    """A JSON string as Python's json.dumps with ensure_ascii=False writes it."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    usual = c
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        usual = F.replace(usual, F.lit(raw), F.lit(escaped))
    rare = usual
    for k in [*range(0, 8), 11, *range(14, 32)]:
        rare = F.replace(rare, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    inner = F.when(c.rlike(r"[\x{0}-\x{7}\x{b}\x{e}-\x{1f}]"), rare).otherwise(usual)
    return F.concat(F.lit('"'), inner, F.lit('"'))


def task_key(model: Column | str, prompt: Column | str) -> Column:
    """Cache key of a plain generation: SHA-256 of {"model", "prompt"} as sorted JSON."""
    return F.sha2(F.concat(F.lit('{"model": '), json_quote(model), F.lit(', "prompt": '), json_quote(prompt), F.lit("}")), 256)


def stage_key(api: Column | str, model: Column | str, prompt: Column | str, stage: Column | str, extra: dict[str, Column] | None = None) -> Column:
    """Cache key of a staged generation: SHA-256 of {"api_kind", "model", "prompt", "stage"} as sorted JSON.

    `extra` adds further fields (temperature, ...) to the key; keys stay sorted.
    """
    fields = {"api_kind": api, "model": model, "prompt": prompt, "stage": stage, **(extra or {})}
    parts: list[Column] = []
    for k, name in enumerate(sorted(fields)):
        parts += [F.lit(("{" if k == 0 else ", ") + f'"{name}": '), json_quote(fields[name])]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)
