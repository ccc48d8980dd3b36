"""Preference rows: filters, projections and constructors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import fence, first_truthy, nonblank, pystrip, same_language
from quillsift.operators.order import post_limit

REQUIRED = ("original_instruction", "fixed_code", "original_code")
PAIR_RULE = "fixed_chosen_original_rejected"


def required(*columns: str) -> Column:
    """All of the columns hold more than white space."""
    out = F.lit(True)
    for c in columns:
        out = out & nonblank(c)
    return out


def message(role: str, content: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def pair(prompt: Column, chosen: Column, rejected: Column, metadata: Column, tag: Column | None = None) -> Column:
    """A conversational preference row; the two codes are stripped and fenced."""
    t = F.lit("python") if tag is None else tag
    return F.struct(
        message("user", prompt).alias("prompt"), message("assistant", fence(chosen, t)).alias("chosen"), message("assistant", fence(rejected, t)).alias("rejected"), metadata.alias("metadata")
    )


def convert(rows: DataFrame, language: str, source: str = "published-preferences", key: str = "row_index") -> DataFrame:
    """Published rows of one language as preference rows; rows with a blank field are left out.

    prompt is the stripped instruction, chosen the fixed and rejected the original code;
    lang, cwe and benign pass as they are. The language is only tested, not rewritten.
    """
    keep = rows.where(same_language("lang", language) & required(*REQUIRED))
    meta = F.struct(
        F.col(key).alias("row_index"), F.lit(source).alias("source"), F.col("lang"), F.col("cwe"), F.col("benign"), F.lit(PAIR_RULE).alias("pair_rule")
    )
    made = pair(pystrip("original_instruction"), F.col("fixed_code"), F.col("original_code"), meta, F.lit(language.lower()))
    return keep.select(made.alias("_p")).select("_p.*")


def conversion(rows: DataFrame, language: str, most: int = 0, key: str = "row_index") -> DataFrame:
    """The rows the converter looks at: those of the language up to the `most`-th accepted, flagged `accepted`."""
    return post_limit(rows.where(same_language("lang", language)), key, required(*REQUIRED), most)


def prune(rows: DataFrame) -> DataFrame:
    """Only what a trainer reads."""
    return rows.select("prompt", "chosen", "rejected")


def category(*places: Column | str) -> Column:
    """The first category that is not empty, in the order task, row, extra."""
    return first_truthy(*places)
