"""Problem 5: records that stand in the training split and in an evaluation split.

A weighted cosine join between the splits. A record is a vector of the numbered words of its
prompt and its answer; a word weighs about log(rows / rows with it), by counts over all rows.
Two records that overlap by t in both fields share at least ceil(t n) words of each field
with n words, so their dot product reaches tau, the sum of the squares of the ceil(t n)
smallest weights of the prompt and of the answer, for either record, and their cosine
reaches tau divided by both norms. Nothing else is assumed of the weights, so nothing is lost.

Terms enter the inverted lists in the order of their weights, the heaviest first, until the
squared norm of the rest is below tau: a pair that reaches it shares a term outside the rest
of either record, and the heaviest shared term stands in both lists. Lists of the two splits
are joined and the products of shared terms summed; a pair stays if sum and residual norm
can reach tau, and if word counts and parity bits allow it. The remaining pairs are decided
by exact products over the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm import tokens
from quillsift.llm.neardup import BLOCK, shared_words, with_members
from quillsift.session import cut_lineage, spread

#: Terms of more rows than this have their lists cut into blocks.
HOT = 100_000


def said(messages: Column) -> Column:
    """The contents of a message list without its system messages; NULL counts as empty."""
    kept = F.filter(messages, lambda m: ~F.coalesce(F.lower(F.trim(m["role"])) == "system", F.lit(False)))
    return F.concat_ws("\n", F.transform(kept, lambda m: m["content"]))


def index_start(squares: np.ndarray, fields: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indexed terms as a mask, tau, squared norm of the rest) for rows of terms sorted by weight.

    `squares` are squared weights, ascending within a row; `fields` says of which field a term is.
    """
    n = len(starts) - 1
    tau = np.zeros(n)
    for k, size in enumerate(sizes):
        mine = fields == k
        at = np.cumsum(mine) - mine
        first = np.concatenate([at, [mine.sum()]])[starts[:-1]] if len(at) else np.zeros(n, dtype=np.int64)
        needed = np.ceil(threshold * size - 1e-9).astype(np.int64)
        smallest = mine & (at - first[rows] < needed[rows])
        tau += np.bincount(rows, weights=np.where(smallest, squares, 0.0), minlength=n)
    total = np.cumsum(squares)
    before = np.concatenate([[0.0], total])[starts[:-1]]
    rest = (total - before[rows]) < tau[rows] * (1 - 1e-7)
    return ~rest, tau, np.bincount(rows, weights=np.where(rest, squares, 0.0), minlength=n)


def lists(docs: DataFrame, threshold: float) -> DataFrame:
    """id, side, class keys, word counts, parity bits, tau, rest and the indexed terms of every record.

    `docs` has id, side, prompt and chosen (array<bigint>). `terms` has a term and its squared
    weight; terms of more than HOT rows come in `hot`.
    """
    counts, total = tokens.id_counts(docs, ["prompt", "chosen"])
    held = docs.sparkSession.sparkContext.broadcast((tokens.rarity(counts, total), counts > HOT))
    plain = [("id", pa.int64()), ("side", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("np", pa.int32()), ("nc", pa.int32()), *[(c, pa.int64()) for c in tokens.ODDS], ("tau", pa.float32()), ("rest", pa.float32())]
    entry = pa.struct([("term", pa.int64()), ("square", pa.float32())])
    schema = pa.schema([*plain, ("terms", pa.list_(entry)), ("hot", pa.list_(entry))])

    def run(batches):
        weights, often = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n = part.num_rows
                found, sizes = [], []
                for salt, name in enumerate(("prompt", "chosen"), 1):
                    values, offsets = tokens.flat(part.column(part.schema.get_field_index(name)))
                    found.append((*tokens.numbered(values, offsets, salt), salt - 1))
                    sizes.append(np.diff(offsets))
                ids, rows = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                fields = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
                heavy = weights[tokens.slots(ids)]
                order = np.lexsort((ids, heavy, rows))
                ids, rows, fields, squares = ids[order], rows[order], fields[order], heavy[order].astype(np.float64) ** 2
                starts = tokens.segments(rows, n)
                taken, tau, rest = index_start(squares, fields, rows, starts, sizes, threshold)
                hot = often[tokens.slots(ids)]
                k1, k2 = tokens.multiset_key(ids, starts)
                columns = [part.column(0), part.column(1), k1.view(np.int64), k2.view(np.int64), sizes[0].astype(np.int32), sizes[1].astype(np.int32), *tokens.parities(ids, rows, n), tau.astype(np.float32), rest.astype(np.float32)]
                arrays = []
                for mask in (taken & ~hot, taken & hot):
                    cut = np.concatenate([[0], np.cumsum(np.bincount(rows[mask], minlength=n))]).astype(np.int32)
                    entries = pa.StructArray.from_arrays([pa.array(ids[mask].view(np.int64)), pa.array(squares[mask].astype(np.float32))], fields=list(entry))
                    arrays.append(pa.ListArray.from_arrays(pa.array(cut), entries))
                yield pa.RecordBatch.from_arrays([*[c if isinstance(c, pa.Array) else pa.array(c) for c in columns], *arrays], schema=schema)

    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.float32(): "float"}
    ddl = ", ".join(f"{c} {kinds[t]}" for c, t in plain) + "".join(f", {c} array<struct<term:bigint,square:float>>" for c in ("terms", "hot"))
    return docs.select("id", "side", "prompt", "chosen").mapInArrow(run, ddl)


class CrossSplit:
    """Links between training records (side 0) and evaluation records (side 1).

    Equal records form a class of which one representative takes part in the join, so a
    prompt or a record that comes again any number of times costs one list entry per term.
    Records without any word are in no link.
    """

    def __init__(self, docs: DataFrame, threshold: float = 0.85):
        self.docs, self.threshold = docs, threshold
        self.lists = cut_lineage(lists(docs, threshold).where("np + nc > 0"))
        facts = [F.max(c).alias(c) for c in ("np", "nc", *tokens.ODDS, "tau", "rest")]
        self.classes = self.lists.groupBy("k1", "k2").agg(
            F.min("id").alias("rep"), F.count_if(F.col("side") == 0).alias("train"), F.count_if(F.col("side") == 1).alias("held"), *facts, F.first("terms").alias("terms"), F.first("hot").alias("hot")
        )

    def _entries(self, side: str, lists: str) -> DataFrame:
        one = self.classes.where(F.col(side) > 0).select("rep", "np", "nc", *tokens.folded(), "tau", "rest", F.explode(lists).alias("_e"))
        return one.select("*", F.col("_e.term").alias("term"), F.col("_e.square").alias("square")).drop("_e")

    def _most(self, x: str, y: str) -> Column:
        each = [tokens.allowed_difference(F.col(f"{x}.{c}"), F.col(f"{y}.{c}"), self.threshold) for c in ("np", "nc")]
        return each[0] + each[1]

    def _met(self, x: DataFrame, y: DataFrame, extra: Column | None = None) -> DataFrame:
        """Products of terms of two lists, for the pairs that sizes and parity bits allow."""
        x, y = x.alias("x"), y.alias("y")
        fits = lambda c: F.least(F.col(f"x.{c}"), F.col(f"y.{c}")) >= F.greatest(F.col(f"x.{c}"), F.col(f"y.{c}")) * F.lit(self.threshold - 1e-12)
        same = (F.col("x.term") == F.col("y.term")) & (F.col("x.rep") != F.col("y.rep")) & fits("np") & fits("nc") & tokens.differ_at_most("x", "y", self._most("x", "y"))
        return x.join(y, same if extra is None else same & extra).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.square").alias("product"), F.greatest("x.tau", "y.tau").alias("tau"), F.greatest("x.rest", "y.rest").alias("rest"))

    def candidates(self) -> DataFrame:
        """(a, b): representatives of a training and of an evaluation class that can reach tau.

        Lists of hot terms are cut into blocks on both sides by their counts, so that a term
        of a third of all rows is spread over many tasks.
        """
        met = self._met(self._entries("train", "terms"), self._entries("held", "terms"))
        x, y = self._entries("train", "hot"), self._entries("held", "hot")
        counted = cut_lineage(
            x.groupBy("term").agg(F.count("*").alias("nx")).join(y.groupBy("term").agg(F.count("*").alias("ny")), "term")
            .select("term", F.ceil(F.col("nx") / (10 * BLOCK)).cast("int").alias("px"), F.ceil(F.col("ny") / (10 * BLOCK)).cast("int").alias("py"))
        )
        if counted.limit(1).count():
            block = lambda parts: F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")
            every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
            left = x.join(counted, "term").withColumn("_bx", block("px")).withColumn("_by", every("py"))
            right = y.join(counted, "term").withColumn("_by", block("py")).withColumn("_bx", every("px"))
            met = met.unionByName(self._met(left, right, (F.col("x._bx") == F.col("y._bx")) & (F.col("x._by") == F.col("y._by"))))
        summed = met.groupBy("a", "b").agg(F.sum("product").alias("dot"), F.max("tau").alias("tau"), F.max("rest").alias("rest"))
        reach = summed.where(F.col("dot") + F.col("rest") >= F.col("tau") * F.lit(1 - 1e-5)).select("a", "b")
        return tokens.only_near(reach, self.lists.select(F.col("id").alias("rep"), "np", "nc", *tokens.ODDS), self._most)

    def links(self) -> DataFrame:
        """(a, b): classes whose prompts and answers both overlap by the threshold or more,
        a with training records and b with evaluation records; a class with both links itself."""
        met = cut_lineage(self.candidates())
        docs = tokens.only_ids(self.docs, "id", met.select("a").unionByName(met.select(F.col("b").alias("a"))))
        left = docs.select(F.col("id").alias("a"), F.col("prompt").alias("_pa"), F.col("chosen").alias("_ca"))
        right = docs.select(F.col("id").alias("b"), F.col("prompt").alias("_pb"), F.col("chosen").alias("_cb"))
        joined = met.join(left, "a").join(right, "b")
        found = shared_words(joined, ["_pa", "_ca"], ["_pb", "_cb"], ["a", "b"], self.threshold).select("a", "b")
        own = self.classes.where("train > 0 and held > 0").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        return found.unionByName(own)

    def members(self) -> DataFrame:
        return self.lists.select("k1", "k2", "id", "side").join(self.classes.select("k1", "k2", "rep", "train", "held"), ["k1", "k2"]).select("rep", "id", "side", "train", "held")

    def pairs(self) -> DataFrame:
        """(train_id, held_id): every linked pair of records."""
        members = self.members()
        train, held = (members.where(F.col("side") == k).withColumnRenamed(c, "copies") for k, c in enumerate(("train", "held")))
        return with_members(with_members(self.links(), train, "a", "train_id"), held, "b", "held_id").select("train_id", "held_id")

    def leaked(self) -> DataFrame:
        """(id, training_records): evaluation records and how many training records each equals or nearly equals."""
        sizes = self.classes.select(F.col("rep").alias("a"), "train")
        each = self.links().join(sizes, "a").groupBy("b").agg(F.sum("train").cast("bigint").alias("training_records"))
        return self.members().where("side = 1").join(each, F.col("rep") == F.col("b")).select("id", "training_records")


def split_records(rows: DataFrame) -> DataFrame:
    """id, side, prompt and chosen words of preference rows; other splits than train, eval and test are left out."""
    split = F.lower(F.trim("split_name"))
    read = spread(rows.where(split.isin("train", "eval", "test")).select(F.col("pref_id").cast("bigint").alias("id"), F.when(split == "train", 0).otherwise(1).alias("side"), said(F.col("prompt")).alias("_p"), said(F.col("chosen")).alias("_c")))
    return read.select("id", "side", tokens.hashed_words(F.col("_p")).alias("prompt"), tokens.hashed_words(F.col("_c")).alias("chosen"))
