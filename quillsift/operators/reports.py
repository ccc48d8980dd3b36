"""Run reports: histograms and conditional counts, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.scoring import is_negative


def histogram(rows: DataFrame, reason: str, otherwise: str = "dpo_pair") -> DataFrame:
    """(reason, n) in the order of the reasons; NULL and empty reasons count as `otherwise`."""
    counted = rows.groupBy(F.coalesce(F.nullif(F.col(reason), F.lit("")), F.lit(otherwise)).alias("reason")).agg(F.count("*").alias("n"))
    return counted.orderBy("reason")


def counts(rows: DataFrame, by: list[str] | None = None, **conditions: Column) -> DataFrame:
    """Number of rows and of rows that meet each condition, overall or by group; NULL is not met."""
    measures = [F.count("*").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]]
    return rows.groupBy(*by).agg(*measures) if by else rows.agg(*measures)


def revision_counts(whole: DataFrame) -> DataFrame:
    """One row: rows, pairs, and how many first answers and revisions are correct and secure."""
    good = lambda c: F.col(f"{c}.eval.correct_secure")
    return counts(whole, None, pairs=F.col("dpo_pair"), first_correct_secure=good("first"), revision_correct_secure=good("revision"))


def negative_counts(whole: DataFrame, least_functionality: float = 1.0, most_security: float = 0.999999) -> DataFrame:
    """One row: rows, pairs, correct and secure references, and over all attempts how many there are and how many match."""
    matches = lambda a: is_negative(a["eval"]["functionality_rate"], a["eval"]["security_rate"], least_functionality, most_security)
    judged = F.filter("negative_attempts", lambda a: a["eval"].isNotNull())
    return whole.agg(
        F.count("*").alias("rows"), F.count_if("dpo_pair").alias("pairs"), F.count_if(F.coalesce(F.col("reference.eval.correct_secure"), F.lit(False))).alias("reference_correct_secure"),
        F.coalesce(F.sum(F.size(judged)), F.lit(0)).cast("bigint").alias("attempts"), F.coalesce(F.sum(F.size(F.filter(judged, matches))), F.lit(0)).cast("bigint").alias("functional_insecure"),
    )
