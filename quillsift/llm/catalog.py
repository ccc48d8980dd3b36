"""The training-data queries by name; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import cutoff, leaks, mixing, neardup, pairs, quota, residue, splits, syntax, tokens
from quillsift.session import cut_lineage, table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Defective answers with their type (TESTDATA problem 1)."""
    return pairs.defective_pairs(table(spark, root, "source_rows"))


def _all_files(spark: SparkSession, root: str, rates: bool) -> DataFrame:
    source = syntax.unparsable_files(
        table(spark, root, "source_rows"), "row_id", ["fixed_code", "original_code"], lang="lang", path="file_path", rates=["repo"] if rates else None
    ).withColumn("table_name", F.lit("source_rows"))
    tasks = syntax.unparsable_files(table(spark, root, "task_rows"), "task_id", ["generated_code"], rates=["repo"] if rates else None).withColumn("table_name", F.lit("task_rows"))
    return source.unionByName(tasks)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Files that do not parse (TESTDATA problem 2)."""
    return _all_files(spark, root, False).select("table_name", "row_id", "field_name")


def p2_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of unparsable files for each repository and language."""
    return syntax.parse_rates(_all_files(spark, root, True), ["repo", "language"])


def _quota(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, root, "preference_rows")
    placed = quota.categories(rows, table(spark, root, "source_rows"))
    return placed, quota.plan(rows, placed, table(spark, root, "sample_targets"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Target categories that the rows at hand cannot fill (TESTDATA problem 3)."""
    return _quota(spark, root)[1].where("short").select("cwe")


def p3_needs(spark: SparkSession, root: str) -> DataFrame:
    """What each target category needs and has."""
    return _quota(spark, root)[1].select("cwe", "need", "available", "short")


def p3_counts(spark: SparkSession, root: str) -> DataFrame:
    """The sample by target category: drawn rows, and whether they lie within minimum and rows at hand; and its size."""
    placed, planned = _quota(spark, root)
    drawn = quota.draw(placed, planned).groupBy("category").agg(F.count("*").alias("drawn"))
    each = planned.join(drawn, "category", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    floor = F.least("min_rows", "available")
    return each.select(F.col("cwe"), ((F.col("drawn") >= floor) & (F.col("drawn") <= F.col("available")) & (F.col("drawn") == F.col("draw"))).alias("within"), F.lit(None).cast("bigint").alias("size")).unionByName(
        each.agg(F.sum("drawn").cast("bigint").alias("size")).select(F.lit("all").alias("cwe"), F.lit(True).alias("within"), "size")
    )


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Need, available and drawn rows of each target category."""
    return _quota(spark, root)[1].select("cwe", "target_pct", "min_rows", "need", "available", "draw", "short")


def p3_sample(spark: SparkSession, root: str) -> DataFrame:
    """The sample itself, each row with its category number."""
    placed, planned = _quota(spark, root)
    return quota.draw(placed, planned)


def _outputs(spark: SparkSession, root: str) -> DataFrame:
    cache = table(spark, root, "generation_cache").select(
        F.lit("generation_cache").alias("table_name"), F.col("gen_id").alias("row_id"), F.lit("raw_output").alias("field_name"), F.col("model").alias("source"), F.col("raw_output").alias("text")
    )
    tasks = table(spark, root, "task_rows").select(
        F.lit("task_rows").alias("table_name"), F.col("task_id").alias("row_id"), F.lit("generated_code").alias("field_name"), F.col("model").alias("source"), F.col("generated_code").alias("text")
    )
    return cache.unionByName(tasks)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Values that were cut before their end (TESTDATA problem 4)."""
    return cutoff.truncated(_outputs(spark, root)).where("cut").select("table_name", "row_id", "field_name")


def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    """How often each table and model truncates."""
    scored = cutoff.truncated(_outputs(spark, root))
    return scored.groupBy("table_name", F.col("source").alias("model")).agg(
        F.count("*").alias("judged"), F.count_if("cut").alias("truncated"), F.round(F.count_if("cut") / F.count("*"), 6).alias("rate")
    )


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of a training record and an evaluation record that is nearly the same (TESTDATA problem 5)."""
    docs = splits.split_records(table(spark, root, "preference_rows"))
    return splits.CrossSplit(docs).pairs().select(F.least("train_id", "held_id").alias("pref_id_a"), F.greatest("train_id", "held_id").alias("pref_id_b"))


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation records that also stand in training, by split and source."""
    rows = table(spark, root, "preference_rows")
    leaked = splits.CrossSplit(splits.split_records(rows)).leaked()
    held = rows.where("split_name <> 'train'").select(F.col("pref_id").alias("id"), "split_name", F.col("metadata.source").alias("source"))
    return held.join(leaked, "id", "left").groupBy("split_name", "source").agg(
        F.count("*").alias("records"), F.count("training_records").alias("overlapping"), F.coalesce(F.sum("training_records"), F.lit(0)).cast("bigint").alias("pairs")
    )


def _records(spark: SparkSession, root: str) -> DataFrame:
    return neardup.with_words(table(spark, root, "source_rows"), "row_id", ["original_instruction", "original_code"])


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of records that are nearly the same (TESTDATA problem 6)."""
    return neardup.NearDuplicates(_records(spark, root)).pairs().select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p6_groups(spark: SparkSession, root: str) -> DataFrame:
    """Every record with its group and its number of links."""
    docs = _records(spark, root)
    return neardup.NearDuplicates(docs).groups(docs.select("id")).withColumnRenamed("id", "row_id")


def _leak_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, root, "documents").select(F.col("doc_id").cast("bigint").alias("id"), tokens.hashed_words(F.col("text")).alias("words"))
    items = table(spark, root, "benchmark_items").select(F.col("item_id").cast("bigint").alias("id"), tokens.hashed_words(F.col("text")).alias("words"))
    return docs, items


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Reviews that hold a passage of an evaluation text (TESTDATA problem 7)."""
    return leaks.leaks(*_leak_tables(spark, root)).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p7_exact(spark: SparkSession, root: str) -> DataFrame:
    """For each leaked item the number of reviews with an exact passage."""
    return leaks.leaks(*_leak_tables(spark, root)).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("reviews"))


def p7_items(spark: SparkSession, root: str) -> DataFrame:
    """For each leaked item the reviews with an exact passage and with an edited copy."""
    found = leaks.alignments(*_leak_tables(spark, root))
    exact, edited = F.col("run") >= 12, F.col("score") >= leaks.SIMILAR
    return found.where(exact | edited).groupBy(F.col("item").alias("item_id")).agg(F.count_if(exact).alias("exact"), F.count_if(edited).alias("edited"), F.max("run").alias("longest_run"), F.round(F.max("score"), 4).alias("best_score"))


def _mix(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Token counts, written down once, and the plan made of them."""
    counted = cut_lineage(mixing.with_tokens(table(spark, root, "documents")))
    return counted, mixing.rates(mixing.sizes(counted), table(spark, root, "mix_targets"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Sources too small for their share (TESTDATA problem 8)."""
    counted = mixing.with_tokens(table(spark, root, "documents"))
    return mixing.rates(mixing.sizes(counted), table(spark, root, "mix_targets")).where("short").select("source")


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The mix: each review with the number of its copy."""
    return mixing.mixed(*_mix(spark, root))


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual shares of the mix."""
    counted, planned = _mix(spark, root)
    return mixing.report(mixing.mixed(counted, planned), planned)


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Reviews that are or hold residue (TESTDATA problem 9)."""
    return residue.residue(table(spark, root, "documents")).select("doc_id")


def p9_clean(spark: SparkSession, root: str) -> DataFrame:
    """The corpus without residue."""
    docs = table(spark, root, "documents")
    return docs.join(residue.residue(docs).select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "text")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_rates": p2_rates, "p3_found": p3_found, "p3_needs": p3_needs, "p3_counts": p3_counts, "p3_report": p3_report, "p3_sample": p3_sample, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p7_exact": p7_exact, "p7_items": p7_items, "p8_found": p8_found, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found, "p9_clean": p9_clean}
ORACLES: dict[str, str] = {}

_CATEGORY = "try_cast(nullif(ltrim(regexp_extract({0}, '\\d+'), '0'), '') AS BIGINT)"
_BLANK = "trim(coalesce({0}, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) = ''"
_PLACED = (
    f"(SELECT p.pref_id, CASE WHEN {_BLANK.format('p.metadata.cwe')} THEN {_CATEGORY.format('s.cwe')} ELSE {_CATEGORY.format('p.metadata.cwe')} END AS category "
    "FROM preference_rows p LEFT JOIN source_rows s ON p.metadata.row_index = s.row_id)"
)
_NEEDS = (
    f"(SELECT t.cwe, greatest(ceil(t.target_pct * (SELECT count(*) // 2 FROM preference_rows) / 100), t.min_rows)::BIGINT AS need, (SELECT count(*) FROM {_PLACED} c WHERE c.category = {_CATEGORY.format('t.cwe')}) AS available FROM sample_targets t)"
)
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
_RUNS = "(SELECT {0} AS id, array_to_string(w[k : k + 11], ' ') AS gram FROM (SELECT {0}, {1} AS w FROM {2}) d, range(1, 100000) r(k) WHERE k <= len(w) - 11)"

ORACLES |= {
    "p3_found": f"SELECT cwe FROM {_NEEDS} WHERE available < need",
    "p7_found": f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM {_RUNS.format('doc_id', _WORDS.format('text'), 'documents')} d JOIN {_RUNS.format('item_id', _WORDS.format('text'), 'benchmark_items')} i USING (gram)",
}

# Numbered words: the k-th time a word stands in a text is a term of its own, so shared terms are shared words.


def _terms(words: str, rows: str, extra: str = "") -> str:
    return f"(SELECT id, w, row_number() OVER (PARTITION BY id, w) AS k FROM (SELECT id, {extra}unnest({words}) AS w FROM {rows}))"


_RECORDS = "(SELECT row_id AS id, coalesce(original_instruction, '') || chr(10) || coalesce(original_code, '') AS text FROM source_rows)"
_SAID = "array_to_string([m.content for m in {0} if coalesce(lower(trim(m.role)), '') <> 'system' and m.content is not null], chr(10))"


def _near(terms: str, left: str = "", pairs: str = "a.id < b.id") -> str:
    """Pairs of ids with their overlap by a join on terms."""
    return (
        f"(WITH t AS {terms}, n AS (SELECT id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT a.id AS x, b.id AS y, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.k = b.k AND {pairs} GROUP BY 1, 2) "
        "SELECT x, y FROM s JOIN n nx ON nx.id = x JOIN n ny ON ny.id = y WHERE shared >= 0.85 * greatest(nx.n, ny.n) - 1e-9)"
    )


def _side(column: str) -> str:
    rows = f"(SELECT pref_id AS id, {_SAID.format(column)} AS text FROM preference_rows)"
    held = "a.id IN (SELECT pref_id FROM preference_rows WHERE split_name = 'train') AND b.id IN (SELECT pref_id FROM preference_rows WHERE split_name <> 'train')"
    return _near(_terms(_WORDS.format("text"), rows), pairs=held)


ORACLES |= {
    "p6_found": f"SELECT x AS row_id_a, y AS row_id_b FROM {_near(_terms(_WORDS.format('text'), _RECORDS))}",
    "p5_found": f"SELECT least(x, y) AS pref_id_a, greatest(x, y) AS pref_id_b FROM {_side('prompt')} JOIN {_side('chosen')} USING (x, y)",
}

_LINKS = ORACLES["p6_found"]
_PAIRS = ORACLES["p5_found"]
_LABELS = (
    "(WITH RECURSIVE e AS (SELECT row_id_a AS a, row_id_b AS b FROM l UNION ALL SELECT row_id_b, row_id_a FROM l), reach(id, other) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other) "
    "SELECT id, least(id, min(other)) AS group_id FROM reach GROUP BY id)"
)
_TARGET_ROWS = f"(SELECT count(*) FROM {_PLACED} c WHERE c.category IN (SELECT {_CATEGORY.format('cwe')} FROM sample_targets))"
ORACLES |= {
    "p3_needs": f"SELECT cwe, need, available, available < need AS short FROM {_NEEDS}",
    "p3_counts": f"SELECT cwe, true AS within, NULL::BIGINT AS size FROM sample_targets UNION ALL SELECT 'all', true, least((SELECT count(*) // 2 FROM preference_rows), {_TARGET_ROWS})",
    "p5_report": (
        f"WITH found AS ({_PAIRS}), split AS (SELECT pref_id, split_name FROM preference_rows), each AS (SELECT CASE WHEN s.split_name = 'train' THEN pref_id_b ELSE pref_id_a END AS pref_id, count(*) AS n FROM found f JOIN split s ON s.pref_id = f.pref_id_a GROUP BY 1) "
        "SELECT p.split_name, p.metadata.source AS source, count(*) AS records, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM preference_rows p LEFT JOIN each USING (pref_id) WHERE p.split_name <> 'train' GROUP BY 1, 2"
    ),
    "p6_groups": (
        f"WITH l AS ({_LINKS}), g AS {_LABELS}, n AS (SELECT id, count(*) AS links FROM (SELECT row_id_a AS id FROM l UNION ALL SELECT row_id_b FROM l) GROUP BY 1) "
        "SELECT s.row_id, coalesce(g.group_id, s.row_id) AS group_id, coalesce(n.links, 0)::BIGINT AS links FROM source_rows s LEFT JOIN g ON g.id = s.row_id LEFT JOIN n ON n.id = s.row_id"
    ),
    "p7_exact": f"SELECT item_id, count(*) AS reviews FROM ({ORACLES['p7_found']}) GROUP BY 1",
}
