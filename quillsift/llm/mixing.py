"""Problem 8: mixing sources to target shares of the total size in tokens."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.values import map_batches, tokenizer_path
from quillsift.session import cut_lineage, spread

# Split pattern of the byte-level tokenizers (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file; one per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def with_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): the token count of each text; NULL and empty texts have 0."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batch: dict[str, list]) -> dict[str, list]:
        tool = encoding(path)
        batch["tokens"] = [len(tool.encode_ordinary(t)) if t else 0 for t in batch["text"]]
        return batch

    return map_batches(spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")), run, "doc_id bigint, source string, tokens bigint")


def sizes(counted: DataFrame) -> DataFrame:
    """(source, tokens) of all documents; partial sums come before the shuffle."""
    return counted.groupBy("source").agg(F.sum("tokens").alias("tokens"))


def rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: tokens it has, tokens wanted, repetition rate (capped), and whether it falls short.

    `sized` is the result of `sizes`, written down before it is used twice. The total is the
    tokens of all documents, those of other or no source included. A source without
    documents has rate 0 and falls short if its target is above 0. As many rows as there
    are targets pass through the driver.
    """
    sized = cut_lineage(sized)
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    joined = targets.select("source", F.col("target_pct").cast("bigint").alias("target_pct"), F.col("max_repeats").cast("bigint").alias("max_repeats")).join(sized, "source", "left").crossJoin(F.broadcast(total))
    tokens = F.coalesce("tokens", F.lit(0))
    wanted = F.col("target_pct") * F.col("total") / 100
    rate = F.when(tokens > 0, F.least(wanted / tokens, F.col("max_repeats").cast("double"))).otherwise(0.0)
    short = tokens * F.col("max_repeats") * 100 < F.col("target_pct") * F.col("total")
    found = joined.select("source", "target_pct", "max_repeats", tokens.alias("tokens"), "total", rate.alias("rate"), short.alias("short"))
    # A local table of the targets' size: Spark knows how small it is, so hot sources are not shuffled to meet it.
    return targets.sparkSession.createDataFrame(found.collect(), found.schema)


def mixed(counted: DataFrame, plan: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, source, copy, tokens): every document floor(rate) times, and once more with a
    probability of the fraction, drawn by a hash of seed and id. NULL sources are not drawn."""
    chosen = counted.join(plan.select("source", "rate"), "source")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("bigint")).cast("int")
    return chosen.withColumn("n", copies).where("n > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "tokens")


def report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share of every source in the mix."""
    got = mix.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"))
    whole = got.agg(F.sum("mixed_tokens").alias("whole"))
    share = F.when(F.col("whole") > 0, F.round(100.0 * F.coalesce("mixed_tokens", F.lit(0)) / F.col("whole"), 4))
    return plan.join(got, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_pct", "max_repeats", "tokens", F.round("rate", 6).alias("rate"), "short", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), share.alias("actual_pct")
    )
