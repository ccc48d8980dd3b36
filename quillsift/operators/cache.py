"""The generation cache as a table: lookups, misses, and the latest entry of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import nonblank


def latest(entries: DataFrame, key: str, *order: str) -> DataFrame:
    """The last entry of each key by `order` (unique within a key).

    An aggregation with partial results, not a window: a key with a third of all entries
    is reduced before the shuffle.
    """
    rest = [c for c in entries.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_e")
    return entries.groupBy(key).agg(newest).select(key, "_e.*").select(*entries.columns)


def usable(output: Column | str, error: Column | str) -> Column:
    """A hit has output and no error; failures are tried again."""
    e = F.col(error) if isinstance(error, str) else error
    return nonblank(output) & F.coalesce(e == "", F.lit(True))


def usable_compat(output: Column | str) -> Column:
    """The looser rule: any output that is not NULL is a hit, the empty text of a failure too."""
    c = F.col(output) if isinstance(output, str) else output
    return c.isNotNull()


def lookup(requests: DataFrame, entries: DataFrame, key: str, hit: Column, carry: list[str]) -> DataFrame:
    """Requests with `cache_hit` and the carried columns of their entry, NULL on a miss.

    `entries` has one row for each key (see `latest`).
    """
    found = entries.where(hit).select(key, *[F.col(c).alias(f"cached_{c}") for c in carry], F.lit(True).alias("cache_hit"))
    return requests.join(found, key, "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def misses(requests: DataFrame, entries: DataFrame, key: str, hit: Column) -> DataFrame:
    """Requests without a usable entry."""
    return requests.join(entries.where(hit).select(key), key, "left_anti")


def replay(requests: DataFrame, entries: DataFrame, key: str, output: str = "raw_output", error: str = "error", compat_empty_hit: bool = False) -> DataFrame:
    """Generation without a model: each request with its recorded output, or an error text.

    The error of a failed entry is kept; a key without entry says so.
    """
    hit = usable_compat(output) if compat_empty_hit else usable(output, error)
    joined = requests.join(entries.select(key, F.col(output).alias("_o"), F.col(error).alias("_e"), hit.alias("_hit")), key, "left")
    good = F.coalesce("_hit", F.lit(False))
    return joined.withColumns(
        {"output": F.when(good, F.col("_o")).otherwise(""), "error": F.when(good, F.lit(None).cast("string")).otherwise(F.coalesce(F.nullif("_e", F.lit("")), F.lit("no recorded generation")))}
    ).drop("_o", "_e", "_hit")


def put(entries: DataFrame, path: str) -> None:
    """Appends entries to a cache table; a later entry of a key wins when read by `latest`."""
    entries.write.mode("append").parquet(path)
