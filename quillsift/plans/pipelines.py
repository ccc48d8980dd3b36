"""The composite flows in replay mode: recorded generations take the place of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions import reasons
from quillsift.functions.text import unfence
from quillsift.operators import attempts as at
from quillsift.operators.prefs import pair


def with_lookup(rows: DataFrame, generated: DataFrame, key: str, output: str) -> DataFrame:
    return rows.join(generated.select(key, unfence(output).alias("code")), key, "left")


def filter_valid(rows: DataFrame, passed: Column, bookkeeping: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all rows, passing rows without their bookkeeping columns)."""
    good = F.coalesce(passed, F.lit(False))
    return rows, rows.where(good).drop(*bookkeeping)


def revision_pairs(tries: DataFrame, key: str, order: str, code: str, good: Column, failed: Column, prompt: Column) -> DataFrame:
    """Two rounds: the first try of each key, and if that is not good its next try.

    Gives (key, outcome, chosen, rejected, prompt, first_good, second_good): outcome NULL is a pair.
    """
    numbered = at.ordered_attempts(tries, key, order, 2).select(key, "attempt", F.col(code).alias("code"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(failed, F.lit(False)).alias("failed"), prompt.alias("prompt"))
    one = lambda k, c: F.max(F.when(F.col("attempt") == k, F.col(c)))
    both = numbered.groupBy(key).agg(one(1, "code").alias("first"), one(1, "good").alias("first_good"), one(1, "failed").alias("first_failed"), one(2, "code").alias("second"), one(2, "good").alias("second_good"), one(2, "failed").alias("second_failed"), one(1, "prompt").alias("prompt"))
    outcome = (
        F.when(F.col("first_failed"), reasons.FIRST_FAILED).when(F.col("first_good"), reasons.FIRST_GOOD).when(F.col("second_good").isNull() | F.col("second_failed"), reasons.REVISION_FAILED).when(~F.col("second_good"), reasons.REVISION_BAD)
    )
    return both.select(key, outcome.alias("outcome"), F.when(outcome.isNull(), F.col("second")).alias("chosen"), F.when(outcome.isNull(), F.col("first")).alias("rejected"), F.when(outcome.isNull(), F.col("prompt")).alias("prompt"), "first_good", "second_good")


def reference_pairs(references: DataFrame, tries: DataFrame, key: str, order: str, qualifies: Column, code: str = "code") -> DataFrame:
    """A trusted reference of each key against its first qualifying attempt.

    `references` has key, ref_id and ref_code, one row for each key. Gives (key, ref_id,
    ref_code, attempt, rejected, outcome): outcome NULL is a pair.
    """
    best = at.winners(tries.select(key, order, F.col(code).alias("code"), qualifies.alias("_q")), key, order, F.col("_q")).select(key, F.col(order).alias("attempt"), F.col("code").alias("rejected"))
    any_try = tries.groupBy(key).agg(F.count("*").alias("tries"))
    joined = references.join(best, key, "left").join(any_try, key, "left")
    outcome = F.when(F.col("attempt").isNotNull(), F.lit(None).cast("string")).when(F.col("tries").isNull(), reasons.NO_ATTEMPTS).otherwise(reasons.NEGATIVE_BAD)
    return joined.select(key, "ref_id", "ref_code", "attempt", "rejected", outcome.alias("outcome"))


def as_rows(pairs: DataFrame, prompt: str, chosen: str, rejected: str, meta: Column) -> DataFrame:
    """Pairs as conversational preference rows."""
    return pairs.select(pair(F.col(prompt), F.col(chosen), F.col(rejected), meta).alias("_p")).select("_p.*")
