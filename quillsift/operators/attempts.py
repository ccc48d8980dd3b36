"""Attempts in order: the first that qualifies wins and ends the row's attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quillsift.operators.order import _numbered

#: Keys over which the rows of one key are spread where they meet a single row.
SALTS = 32


def meet(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join on key of many rows with one row each, the many spread over SALTS keys by a hash of the row."""
    plain = [f.name for f in many.schema.fields if not isinstance(f.dataType, MapType)]
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    every = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, [key, "_salt"], how).drop("_salt")


def expand(rows: DataFrame, most: int, name: str = "attempt") -> DataFrame:
    """Every row once for each attempt 1..max(1, most)."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(max(1, most)))))


def first_match(attempts: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """(key, order of the first attempt that qualifies); rows without one are absent.

    A minimum with partial sums: a key with any number of attempts needs no sort.
    """
    return attempts.where(ok).groupBy(key).agg(F.min(order).alias(order))


def winners(attempts: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """The first qualifying attempt of each key, whole."""
    best = F.min_by(F.struct(*[F.col(c) for c in attempts.columns if c != key]), F.col(order)).alias("_w")
    return attempts.where(ok).groupBy(key).agg(best).select(key, "_w.*")


def made(attempts: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """Attempts that take place at all: those up to and with the first that qualifies."""
    end = first_match(attempts, key, order, ok).withColumnRenamed(order, "_end")
    return meet(attempts, end, key, "left").where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")


def last_reason(attempts: DataFrame, key: str, order: str, ok: Column, reason: Column) -> DataFrame:
    """(key, reason): the reason of the last attempt of every key where none qualifies."""
    good = F.coalesce(ok, F.lit(False))
    return attempts.groupBy(key).agg(F.max_by(reason, F.col(order)).alias("reason"), F.max(good).alias("_any")).where(~F.col("_any")).select(key, "reason")


def ordered_attempts(rows: DataFrame, key: str, order: str, most: int | None = None, name: str = "attempt") -> DataFrame:
    """Numbers the rows of each key from 1 in order; `most` keeps the first so many.

    `order` is unique within a key. Only key and order are numbered, as a whole over range
    partitions, and the number of each key's first row is taken off. That number is found
    for each partition a key lies in and joined by key and partition, so a key with a third
    of all rows is spread over as many tasks as it has partitions. NULL keys are one key.
    """
    narrow = _numbered(rows.select(F.col(key).alias("__key"), F.col(order).alias("__order")), ["__key", "__order"], "__n", keep_place=True)
    local = narrow.groupBy("__key", "__part").agg(F.min("__n").alias("__low"))
    whole = local.groupBy(F.col("__key").alias("__of")).agg(F.min("__low").alias("__first"))
    placed = local.join(whole, F.col("__key").eqNullSafe(F.col("__of"))).select("__of", F.col("__part").alias("__in"), "__first")
    same = F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__in"))
    numbers = narrow.join(placed, same).select("__key", "__order", (F.col("__n") - F.col("__first") + 1).cast("int").alias(name))
    if most is not None:
        numbers = numbers.where(F.col(name) <= most)
    return rows.join(numbers, F.col(key).eqNullSafe(F.col("__key")) & F.col(order).eqNullSafe(F.col("__order"))).drop("__key", "__order")
