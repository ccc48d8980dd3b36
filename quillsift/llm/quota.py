"""Problem 3: a sample that matches target proportions over a category tree."""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Place of each weakness class in the public taxonomy: pillar, then class (fixed values).
TREE = {
    22: (664, 706), 77: (707, 74), 78: (707, 74), 79: (707, 74), 89: (707, 74), 95: (707, 94), 119: (664, 118), 200: (664, 668), 295: (284, 287), 338: (693, 330), 352: (693, 345),
    377: (664, 668), 502: (664, 913), 601: (664, 610), 611: (664, 610), 770: (664, 400), 779: (664, 400), 862: (284, 285), 863: (284, 285), 915: (664, 913), 918: (664, 610), 1333: (664, 400),
}

#: Rows of a category are counted in 2**BIN_BITS ranges of their hash.
BIN_BITS = 12


def cwe_number(text: Column) -> Column:
    """The number in any spelling of a category, leading zeros aside; NULL if there is none."""
    digits = F.regexp_extract(text, r"0*(\d+)", 1)
    return F.when(digits != "", F.try_to_number(F.substring(digits, 1, 12), F.lit("999999999999")).cast("bigint"))


def blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", ""), F.lit("")) == ""


def categories(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(pref_id, category): the number in metadata.cwe, or if that is NULL or blank the one of
    the source row it names; NULL if neither gives a number.

    Only rows without a category of their own are joined; a hot row_index is split by AQE.
    """
    own = rows.select(F.col("pref_id"), F.col("metadata.cwe").alias("_cwe"), F.col("metadata.row_index").alias("_row"))
    spelled = own.where(~blank(F.col("_cwe"))).select("pref_id", cwe_number(F.col("_cwe")).alias("category"))
    missing = own.where(blank(F.col("_cwe")))
    named = sources.select(F.col("row_id").alias("_row"), cwe_number(F.col("cwe")).alias("category"))
    return spelled.unionByName(missing.join(named, "_row", "left").select("pref_id", "category"))


def apportion(total: int, weights: dict, low: dict, high: dict) -> dict:
    """Whole numbers in proportion to the weights, each within [low, high], with the given sum.

    The sum is kept within the sums of the bounds. What a bound takes away or adds is shared
    by the others in proportion; fractions go to the largest remainders, ties to the first
    key. Keys without weight get their lower bound, and more only when all others are full.
    """
    total = max(sum(low.values()), min(total, sum(high.values())))
    keys = sorted(weights)
    reach = lambda x: sum(min(max(Fraction(weights[k]) * x, low[k]), high[k]) for k in keys)
    turns = sorted({Fraction(bound[k]) / Fraction(weights[k]) for k in keys if weights[k] > 0 for bound in (low, high)})
    under = [x for x in turns if reach(x) <= total]
    start = under[-1] if under else Fraction(0)
    free = [k for k in keys if weights[k] > 0 and low[k] <= Fraction(weights[k]) * start < high[k]]
    slope = sum(Fraction(weights[k]) for k in free)
    scale = start + ((total - reach(start)) / slope if slope else 0)
    exact = {k: min(max(Fraction(weights[k]) * scale, low[k]), high[k]) for k in keys}
    out = {k: int(x) for k, x in exact.items()}
    left = total - sum(out.values())
    for k in sorted(keys, key=lambda k: (out[k] - exact[k], k)):
        if left > 0 and exact[k] > out[k]:
            out[k] += 1
            left -= 1
    for k in keys:  # only rows of categories without weight are left
        more = min(left, high[k] - out[k])
        out[k] += more
        left -= more
    return out


def allocate(size: int, percent: dict[int, int], least: dict[int, int], available: dict[int, int], tree: dict[int, tuple[int, ...]] = TREE) -> dict[int, int]:
    """Rows to draw from each category: `size` in all, or all there are if these are fewer.

    The quota of the root goes down the tree. Every node divides its quota among its
    children in proportion to their percentages, no child getting less than the minimums
    below it or more than the rows below it. So what a category cannot fill goes to its
    siblings, and only what a whole class cannot fill to its cousins, and so on up. Rounding
    and minimums are taken out of the other categories. If the minimums alone exceed the
    size, they are cut in proportion.
    """
    have = {c: available.get(c, 0) for c in percent}
    floor = {c: min(least[c], have[c]) for c in percent}
    if sum(floor.values()) > size:
        floor = apportion(size, floor, dict.fromkeys(floor, 0), floor)
    drawn: dict[int, int] = {}

    def share(quota: int, cats: list[int], depth: int) -> None:
        branches: dict = defaultdict(list)
        for c in cats:
            path = tree.get(c, ())
            branches[(0, path[depth]) if depth < len(path) else (1, c)].append(c)
        total = lambda of: {b: sum(of[c] for c in below) for b, below in branches.items()}
        for branch, part in apportion(quota, total(percent), total(floor), total(have)).items():
            if branch[0]:
                drawn[branch[1]] = part
            else:
                share(part, branches[branch], depth + 1)

    share(size, list(percent), 0)
    return drawn


def plan(rows: DataFrame, placed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: need, available rows, rows to draw, and whether it falls short.

    The sample is half the rows, rounded down. Only the targets and their counts, as many
    as there are target categories, reach the driver.
    """
    spark = rows.sparkSession
    size = rows.count() // 2
    wanted = targets.select("cwe", F.col("target_pct").cast("bigint").alias("target_pct"), F.col("min_rows").cast("bigint").alias("min_rows"), cwe_number(F.col("cwe")).alias("category"))
    counts = placed.where("category is not null").groupBy("category").agg(F.count("*").alias("available"))
    found = wanted.join(counts, "category", "left").select("cwe", "category", "target_pct", "min_rows", F.coalesce("available", F.lit(0)).alias("available")).collect()
    need = {r["category"]: max(-(-r["target_pct"] * size // 100), r["min_rows"]) for r in found}
    of = lambda c: {r["category"]: r[c] for r in found}
    drawn = allocate(size, of("target_pct"), of("min_rows"), of("available"))
    out = [(r["cwe"], r["category"], r["target_pct"], r["min_rows"], need[r["category"]], r["available"], drawn[r["category"]], r["available"] < need[r["category"]]) for r in found]
    return spark.createDataFrame(out, "cwe string, category bigint, target_pct bigint, min_rows bigint, need bigint, available bigint, draw bigint, short boolean")


def draw(placed: DataFrame, planned: DataFrame, seed: int = 5) -> DataFrame:
    """(pref_id, category): the planned number of rows of each category, by permuted dense rank.

    Rows are permuted by a hash of seed and id. Counts by category and range of the hash
    give the range in which the last wanted row lies; only that range is ranked, so no
    category, however large, is sorted in one task.
    """
    hashed = placed.join(planned.select("category", "draw").where("draw > 0"), "category").withColumn("h", F.xxhash64(F.lit(seed), F.col("pref_id")))
    hashed = hashed.withColumn("bin", F.shiftrightunsigned("h", 64 - BIN_BITS).cast("int"))
    counts = hashed.groupBy("category", "bin", "draw").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("category").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    edges = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < F.col("draw")).select("category", "bin", "before", "n", "draw")
    whole = edges.where(F.col("before") + F.col("n") <= F.col("draw")).select("category", "bin")
    part = edges.where(F.col("before") + F.col("n") > F.col("draw")).select("category", "bin", (F.col("draw") - F.col("before")).alias("rest"))
    base = hashed.select("pref_id", "category", "bin", "h")
    taken = base.join(whole, ["category", "bin"], "left_semi").select("pref_id", "category")
    rank = F.dense_rank().over(Window.partitionBy("category", "bin").orderBy("h", "pref_id"))
    ranked = base.join(part, ["category", "bin"]).withColumn("rank", rank).where(F.col("rank") <= F.col("rest")).select("pref_id", "category")
    return taken.unionByName(ranked)
