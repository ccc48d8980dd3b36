"""Word multisets as hashed vectors, and a count sketch of fixed size over all of them.

The JVM cuts texts into words and hashes them; numpy does the rest on flat arrays.
A multiset becomes a set by numbering the repetitions of a word, so that the number of
shared ids of two texts is the number of words they share with repetition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_BITS = 20
#: Words of parity bits of a record, and their columns.
ODD = 8
ODDS, FOLDS = tuple(f"odd{k}" for k in range(ODD)), ("fold0", "fold1")
MAP_BITS = 24
BLOCKS = 64
#: Partial results that one task merges.
GROUP = 64
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def hashed_words(text: Column) -> Column:
    """array<bigint>: the hash of every word of a text, in order. NULL counts as empty."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (uint64) and offsets of a list<int64> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = np.asarray(column.values, dtype=np.int64)[offsets[0] : offsets[-1]]
    return values.view(np.uint64), offsets - offsets[0]


def numbered(values: np.ndarray, offsets: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row of each id), sorted by row; ids are distinct within a row.

    Up to 4,096 rows are sorted by one key of row and hash, which is several times faster.
    """
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    if n <= 4096:
        order = np.argsort((rows.astype(np.uint64) << np.uint64(52)) | (values >> np.uint64(12)))
    else:
        order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    start = np.ones(len(v), dtype=bool)
    if len(v):
        start[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    first = np.maximum.accumulate(np.where(start, np.arange(len(v)), 0)) if len(v) else np.zeros(0, dtype=np.int64)
    repeat = (np.arange(len(v)) - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(v + (repeat + np.uint64(1 + 1000 * salt)) * _C1), r


def segments(rows: np.ndarray, n: int) -> np.ndarray:
    """Start of each row's stretch in a sorted row array, with the end as last item."""
    return np.searchsorted(rows, np.arange(n + 1))


def reduce_rows(function: np.ufunc, x: np.ndarray, starts: np.ndarray, empty) -> np.ndarray:
    """ufunc over each row's stretch; rows without any get `empty`."""
    n = len(starts) - 1
    out = np.full(n, empty, dtype=x.dtype)
    some = np.flatnonzero(starts[1:] > starts[:-1])
    if len(some):
        out[some] = function.reduceat(x, starts[:-1][some])
    return out


def merge_levels(partitions: int) -> int:
    """How often blocks of counters are merged, GROUP partial results at a time, until one is left."""
    levels = 1
    while partitions > GROUP:
        partitions, levels = -(-partitions // GROUP), levels + 1
    return levels


def id_counts(frame: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """In how many rows each numbered word occurs, in 2**SLOT_BITS counters, and the number of rows.

    `columns` are word arrays; the k-th of them is numbered with salt k (0 if there is only
    one). Every partition sums its counters; partial results are then merged in levels of at
    most GROUP per task, so a task holds GROUP blocks of 128 KB at any number of partitions.
    What reaches the driver has a fixed size (8 MB). Words that share a counter look more
    frequent than they are, which costs some speed later but no result.
    """
    width = (1 << SLOT_BITS) // BLOCKS
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])
    ddl = "part int, block int, counts binary"
    salts = range(1, len(columns) + 1) if len(columns) > 1 else (0,)

    def partial(batches):
        from pyspark import TaskContext

        total, rows = np.zeros(1 << SLOT_BITS, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for at in range(0, batch.num_rows, 4000):
                for salt, column in zip(salts, batch.slice(at, 4000).columns):
                    np.add(total, np.bincount(slots(numbered(*flat(column), salt)[0]), minlength=1 << SLOT_BITS), out=total)
        if rows:
            part = TaskContext.get().partitionId()
            for k in range(BLOCKS):
                counts = np.append(total[k * width : (k + 1) * width], rows if k == 0 else 0)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([counts.tobytes()], pa.binary())], schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(width + 1, dtype=np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), dtype=np.int64)
        first = lambda c: pa.array([table.column(c)[0].as_py()], pa.int32())
        return pa.Table.from_arrays([first("part"), first("block"), pa.array([total.tobytes()], pa.binary())], schema=schema)

    merged = frame.select(*columns).mapInArrow(partial, ddl)
    for _ in range(merge_levels(frame.rdd.getNumPartitions())):
        merged = merged.withColumn("part", F.expr(f"part div {GROUP}").cast("int")).groupBy("part", "block").applyInArrow(merge, ddl)
    out, rows = np.zeros(1 << SLOT_BITS, dtype=np.int64), 0
    for row in merged.collect():
        got = np.frombuffer(row["counts"], dtype=np.int64)
        out[row["block"] * width : (row["block"] + 1) * width] += got[:-1]
        rows += int(got[-1])
    return out, rows


def slots(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def rarity(counts: np.ndarray, rows: int) -> np.ndarray:
    """Weight of each counter's words, about log(rows / occurrences), as float32."""
    return (np.log(max(rows, 1) / np.maximum(np.minimum(counts, rows), 1)) + 0.05).astype(np.float32)


def parities(ids: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """64 * ODD bits for each row, as ODD int64 columns: whether an odd number of ids falls into each of so many bins.

    Two sets that differ in d ids differ in d bits at most, so bits can rule pairs out but
    never rule out a pair that is near enough (see `differ_at_most`).
    """
    bins = 64 * ODD
    odd = (np.bincount(rows * bins + (ids & np.uint64(bins - 1)).astype(np.int64), minlength=bins * n) & 1).astype(np.uint8)
    words = np.packbits(odd.reshape(n, bins), axis=1, bitorder="little").view(np.int64)
    return [np.ascontiguousarray(words[:, k]) for k in range(ODD)]


def folded() -> list[Column]:
    """The bits of `parities` over a quarter of the bins, as columns fold0 and fold1; the bound holds for them too."""
    half = [F.col(f"odd{k}") for k in range(ODD)]
    fold = lambda of: reduce(lambda x, y: x.bitwiseXOR(y), of)
    return [fold(half[0::2]).alias("fold0"), fold(half[1::2]).alias("fold1")]


def differ_at_most(left: str, right: str, most: Column, names: Sequence[str] = FOLDS) -> Column:
    """Whether the parity bits of two aliased frames allow a difference of `most` ids."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in names]) <= most


def only_near(pairs: DataFrame, facts: DataFrame, most: Callable[[str, str], Column]) -> DataFrame:
    """The pairs (a, b) whose parity bits over all bins allow a difference of most(x, y); `facts` has rep and the bits."""
    x, y = facts.alias("x"), facts.alias("y")
    met = pairs.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep"))
    return met.where(differ_at_most("x", "y", most("x", "y"), ODDS)).select("a", "b")


def only_ids(frame: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of `frame` whose id can be among the ids of `wanted` (one column).

    Wanted ids set bits of a map of 2 MB, whatever their number; it goes to all executors
    before the wide rows of `frame` are shuffled. When the map fills up, more rows pass.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS))
    slot = wanted.select(place(F.col(wanted.columns[0])).alias("h"))
    bits = slot.groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    words[np.asarray(bits.column("word"))] = np.asarray(bits.column("bits")).view(np.uint64)
    held = frame.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def among(h: pd.Series) -> pd.Series:
        at = h.to_numpy().astype(np.uint64)
        return pd.Series((held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    return frame.where(among(place(F.col(column))))


def allowed_difference(one: Column, two: Column, threshold: float) -> Column:
    """In how many words two texts of these sizes can differ and still overlap by the threshold."""
    return one + two - 2 * F.ceil(F.greatest(one, two) * F.lit(threshold) - F.lit(1e-9))


def multiset_key(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that are equal for equal sets of ids (sums of mixed ids)."""
    with np.errstate(over="ignore"):
        zero = np.uint64(0)
        return reduce_rows(np.add, mix(ids ^ _C1), starts, zero), reduce_rows(np.add, mix(ids + _C3), starts, zero)
