"""Row order as data: ordinals, limits and exact samples without a single-task sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.session import cut_lineage


def with_ordinal(rows: DataFrame, *keys: str, name: str = "row_index", unique: bool = True, keep: Column | None = None) -> DataFrame:
    """Numbers the rows from 0 in the order of the keys; NULL keys come first.

    Keys are range-partitioned and sorted once and written to the shared folder, so that the
    second reading sees the same partitions; only one count for each partition is collected.
    With unique keys only the keys are written, and the rows join their numbers. Otherwise
    whole rows are written and ties are numbered in any order. An old column of that name
    is replaced; an empty table stays empty. All rows are numbered; with `keep` only those
    it holds for are given, and only they are shuffled to meet their numbers.
    """
    if name in rows.columns:
        rows = rows.drop(name)
    if not unique or set(rows.columns) == set(keys):
        numbered = _numbered(rows, keys, name)
        return numbered if keep is None else numbered.where(keep)
    plain = [f"__k{k}" for k in range(len(keys))]
    numbers = _numbered(rows.select(*[F.col(c).alias(p) for c, p in zip(keys, plain)]), plain, name)
    same = F.lit(True)
    for c, p in zip(keys, plain):
        same = same & F.col(c).eqNullSafe(F.col(p))
    return (rows if keep is None else rows.where(keep)).join(numbers, same).drop(*plain)


def _numbered(rows: DataFrame, keys, name: str, keep_place: bool = False) -> DataFrame:
    """The rows with their numbers, and with the range partition (`__part`) they lie in if wanted."""
    place, base = "__part", "__at"
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(place, F.spark_partition_id()).withColumn(base, F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)
    sizes = ordered.groupBy(place).agg(F.count("*").alias("n"), F.min(base).alias("first")).orderBy(place).collect()
    if not sizes:
        return ordered.select(*rows.columns, *([place] if keep_place else []), F.lit(0).cast("bigint").alias(name))
    shift, before = {}, 0
    for r in sizes:
        shift[r[place]] = before - r["first"]
        before += r["n"]
    moves = F.create_map(*[F.lit(x) for k, v in shift.items() for x in (k, v)])
    return ordered.select(*rows.columns, *([place] if keep_place else []), (F.col(base) + moves[F.col(place)]).cast("bigint").alias(name))


def pre_limit(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n source rows by key (unique); 0 and negative numbers mean all.

    Keys are numbered over range partitions, so no task gathers n rows.
    """
    if n <= 0:
        return rows
    return with_ordinal(rows, key, name="__rank").where(F.col("__rank") < n).drop("__rank").select(*rows.columns)


def cut_off(rows: DataFrame, key: str, accepted: Column, n: int) -> DataFrame:
    """(last): the key of the n-th accepted row; NULL if there are fewer or n is 0 or less (then all count)."""
    if n <= 0:
        return rows.sparkSession.createDataFrame([(None,)], f"last {rows.schema[key].dataType.simpleString()}")
    numbered = with_ordinal(rows.where(accepted).select(key), key, name="__rank")
    return numbered.where(F.col("__rank") == n - 1).agg(F.max(key).alias("last"))


def post_limit(rows: DataFrame, key: str, accepted: Column, n: int) -> DataFrame:
    """Rows up to the n-th accepted one, with a column `accepted`. Later rows are never
    looked at, so they count neither as accepted nor as skipped."""
    last = cut_off(rows, key, accepted, n)
    flagged = rows.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    return flagged.crossJoin(F.broadcast(last)).where(F.col("last").isNull() | (F.col(key) <= F.col("last"))).drop("last")


def smallest_by_hash(rows: DataFrame, key: str, count: int, seed: str, bits: int = 12) -> DataFrame:
    """Exactly `count` rows (or all): those with the least SHA-256 of seed and key.

    A histogram over ranges of the hash finds the range of the last row; only that range
    is sorted. Ties of the hash are broken by the key.
    """
    hashed = rows.withColumn("__h", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    hashed = hashed.withColumn("__bin", F.conv(F.substring("__h", 1, bits // 4), 16, 10).cast("int"))
    left, edge, rest = count, None, 0
    for r in hashed.groupBy("__bin").count().orderBy("__bin").collect():
        if left <= r["count"]:
            edge, rest = r["__bin"], left
            break
        left -= r["count"]
    if edge is None:
        return hashed.drop("__h", "__bin") if count > 0 else rows.limit(0)
    rank = F.row_number().over(Window.partitionBy("__bin").orderBy("__h", key))
    whole = hashed.where(F.col("__bin") < edge)
    part = hashed.where(F.col("__bin") == edge).withColumn("__rank", rank).where(F.col("__rank") <= rest).drop("__rank")
    return whole.unionByName(part).drop("__h", "__bin")


def exact_split(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """(train, eval): eval has exactly ceil(ratio * n) rows, the same on every run; None if ratio is 0."""
    if ratio <= 0:
        return rows, None
    held = smallest_by_hash(rows, key, math.ceil(round(ratio * rows.count(), 9)), str(seed))
    return rows.join(held.select(key), key, "left_anti"), held


def evaluation_split(rows: DataFrame, key: str, held: DataFrame | None, ratio: float, seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """(train, eval): given evaluation rows as they are, else an exact sample, else none."""
    return (rows, held) if held is not None else exact_split(rows, key, ratio, seed)
