"""Problem 6: near-duplicate records, by a chosen-path set similarity join.

Each record is a set of numbered words. In each of several independent trees a record
follows a path of minwise words; all records that took the same words stand in one node.
Two sets choose the same word with a probability of their Jaccard similarity, which is at
least t / (2 - t) for an overlap of t, whatever the words are. Paths end where a node is
expected to be small. The nodes are then counted: records of a small node are compared
with each other, larger nodes branch again, in several children for each record, as long
as that pays; what cannot be separated is compared in blocks. No pair is ruled out but by
bounds that hold for certain.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import tokens
from quillsift.session import cut_lineage, spread

RECALL = 0.9995
#: A path goes on while its node is expected to hold more records than this.
NODE = 32
#: Nodes up to this size are compared; larger ones branch again.
SMALL = 128
#: Rows of one block where a group is compared with itself.
BLOCK = 1000
#: Steps and children of a branch; a pair that shares a node shares a child with a probability of `kept`.
STEPS, CHILDREN = 2, 4
#: Minwise words of a record that branches choose from.
SIGNS = 16
FACTS = ("rep", "n", "fold0", "fold1")


def step(threshold: float) -> float:
    """The least probability that two records of this overlap choose the same word."""
    return threshold / (2 - threshold)


def kept(threshold: float) -> float:
    """The least probability that a pair of one node shares a child of it.

    The mean over how many of the SIGNS words of the pair agree.
    """
    p = step(threshold)
    agree = [math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k) for k in range(SIGNS + 1)]
    return sum(a * (1 - (1 - (k / SIGNS) ** STEPS) ** CHILDREN) for k, a in enumerate(agree))


def trees_for(recall: float, depth: int, threshold: float) -> int:
    """Independent trees needed so that a pair at the threshold is missed in all of them with
    1 - recall, if its node branched once more in every tree."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - kept(threshold) * step(threshold) ** depth)))


def depth_for(counts: np.ndarray, rows: int, node: float = NODE) -> int:
    """Steps after which a node is expected to be small, for words drawn as they occur."""
    often = counts[counts > 0]
    if rows <= node or not len(often):
        return 1
    mean = float((often * -np.log(np.minimum(1.0, often / rows))).sum() / often.sum())
    return max(1, math.ceil(math.log(rows / node) / max(mean, 1e-3)))


def _chosen(ids: np.ndarray, starts: np.ndarray, function: int) -> np.ndarray:
    """The minwise id of every row under one function; rows without ids get some word.

    Ids are hashes already, so a product with an odd number orders them anew, and its
    inverse gives the least one back.
    """
    seed = tokens.mix(np.array([function, function + (1 << 40)], dtype=np.uint64))
    odd, flip = int(seed[0]) | 1, seed[1]
    with np.errstate(over="ignore"):
        least = tokens.reduce_rows(np.minimum, (ids ^ flip) * np.uint64(odd), starts, np.uint64(0))
        return (least * np.uint64(pow(odd, -1, 1 << 64))) ^ flip


def walk(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, tree: int, total: int, share: np.ndarray, depth: int) -> np.ndarray:
    """The key of the node of a tree every row ends in; `share` is the part of all records that has a word, by counters."""
    n = len(starts) - 1
    key, size = np.full(n, tree + 1, dtype=np.uint64), np.full(n, float(total))
    for level in range(depth):
        going = (size > NODE) | (level == 0)
        if not going.any():
            break
        word = _chosen(ids, starts, 1000 * (tree + 1) + level)
        with np.errstate(over="ignore"):
            key = np.where(going, tokens.mix(key * np.uint64(31) + word + np.uint64(level)), key)
        size = np.where(going, size * share[tokens.slots(word)], size)
    return key


def fingerprints(docs: DataFrame, recall: float = RECALL, threshold: float = 0.85) -> tuple[DataFrame, int]:
    """id, class keys, word count, parity bits, the node of each tree (`paths`) and minwise words (`signs`); the tree count.

    `docs` has id and words (array<bigint>). Rows without words get a key of their own.
    """
    counts, total = tokens.id_counts(docs, ["words"])
    shares = np.minimum(1.0, counts / max(total, 1)).astype(np.float32)
    depth = depth_for(counts, total)
    trees = trees_for(recall, depth, threshold)
    held = docs.sparkSession.sparkContext.broadcast(shares)
    names = ["id", "k1", "k2", "n", *tokens.ODDS]
    schema = pa.schema([(c, pa.int32() if c == "n" else pa.int64()) for c in names] + [(c, pa.list_(pa.int64())) for c in ("paths", "signs")])

    def run(batches):
        share = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n = part.num_rows
                ids, rows = tokens.numbered(*tokens.flat(part.column(1)))
                starts = tokens.segments(rows, n)
                k1, k2 = tokens.multiset_key(ids, starts)
                columns = [part.column(0), k1.view(np.int64), k2.view(np.int64), np.diff(starts).astype(np.int32), *tokens.parities(ids, rows, n)]
                lists = [[walk(ids, rows, starts, t, total, share, depth) for t in range(trees)], [_chosen(ids, starts, k) for k in range(SIGNS)]]
                arrays = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(x), pa.int32()), pa.array(np.stack(x, axis=1).ravel().view(np.int64))) for x in lists]
                yield pa.RecordBatch.from_arrays([*[c if isinstance(c, pa.Array) else pa.array(c) for c in columns], *arrays], schema=schema)

    ddl = ", ".join(f"{c} {'int' if c == 'n' else 'bigint'}" for c in names) + ", paths array<bigint>, signs array<bigint>"
    return docs.select("id", "words").mapInArrow(run, ddl), trees


def branches(members: DataFrame) -> DataFrame:
    """(rep, parent, node): CHILDREN nodes for every record of a large node.

    `members` has rep, node and signs. Which of its minwise words lead to a child is drawn
    anew for each node and child.
    """
    place = lambda c, k: F.pmod(F.xxhash64("node", c, F.lit(k)), F.lit(SIGNS)).cast("int")
    taken = lambda c: F.xxhash64("node", c, *[F.get("signs", place(c, k)) for k in range(STEPS)])
    children = F.array(*[taken(F.lit(c)) for c in range(CHILDREN)])
    return members.select("rep", F.col("node").alias("parent"), F.explode(children).alias("node"))


def with_words(rows: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """id and words of the fields taken together as one text; NULL fields count as empty."""
    text = F.concat_ws("\n", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    read = spread(rows.select(F.col(id_column).cast("bigint").alias("id"), text.alias("_text")))
    return read.select("id", tokens.hashed_words(F.col("_text")).alias("words"))


def shared_words(frame: DataFrame, left: list[str], right: list[str], keep: list[str], threshold: float) -> DataFrame:
    """Rows of `frame` whose word arrays left[k] and right[k] overlap by the threshold, for all k.

    The overlap is the number of shared words, with repetition, over the count of the longer.
    Two texts without words overlap fully, one without words and one with words not at all.
    """
    width = len(keep)
    names = [*keep, *[f"overlap{k}" for k in range(len(left))]]
    schema = pa.schema([(c, pa.int64()) for c in keep] + [(c, pa.float64()) for c in names[width:]])

    def overlap(one, two, n: int) -> np.ndarray:
        (va, oa), (vb, ob) = tokens.flat(one), tokens.flat(two)
        ia, ra = tokens.numbered(va, oa)
        ib, rb = tokens.numbered(vb, ob)
        ids, rows = np.concatenate([ia, ib]), np.concatenate([ra, rb])
        order = np.argsort((rows.astype(np.uint64) << np.uint64(52)) | (ids >> np.uint64(12)))
        ids, rows = ids[order], rows[order]
        same = (ids[1:] == ids[:-1]) & (rows[1:] == rows[:-1])
        shared = np.bincount(rows[1:][same], minlength=n)
        longer = np.maximum(np.diff(oa), np.diff(ob))
        return np.where(longer == 0, 1.0, shared / np.maximum(longer, 1))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = [overlap(part.column(width + 2 * k), part.column(width + 2 * k + 1), part.num_rows) for k in range(len(left))]
                good = np.flatnonzero(np.all([f >= threshold - 1e-12 for f in found], axis=0))
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(good)) for k in range(width)], *[pa.array(f[good]) for f in found]], schema=schema)

    columns = [*keep, *[c for pair in zip(left, right) for c in pair]]
    return frame.select(*columns).mapInArrow(run, ", ".join([*[f"{c} bigint" for c in keep], *[f"{c} double" for c in names[width:]]]))


def self_pairs(rows: DataFrame, group: str, size: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two sides x and y of a join of every group with itself, in blocks of BLOCK rows.

    Joined on `group` and `_block`, each pair of rows of a group meets twice, once in either
    order, and no task holds more than BLOCK rows of x with the rows of y, so a group of any
    size is spread over many tasks. `rep` tells rows apart.
    """
    parts = F.ceil(F.col(size) / BLOCK).cast("int")
    one = rows.select(group, *keep, F.pmod(F.xxhash64("rep"), parts).cast("int").alias("_block"))
    two = rows.select(group, *keep, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_block"))
    return one.alias("x"), two.alias("y")


def with_members(links: DataFrame, members: DataFrame, at: str, name: str) -> DataFrame:
    """Links with every member of the class that column `at` names, as column `name`.

    `members` has rep, id and copies, the size of the class. Links meet large classes in
    blocks of BLOCK members, so that a class of a third of all rows is many tasks.
    """
    parts = F.ceil(F.col("copies") / BLOCK).cast("int")
    own = members.select(F.col("rep").alias(at), F.col("id").alias(name), F.pmod(F.xxhash64("id"), parts).cast("int").alias("_block"))
    blocks = members.groupBy(F.col("rep").alias(at)).agg(F.max(parts).alias("_parts"))
    return links.join(blocks, at).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).join(own, [at, "_block"]).drop("_block", "_parts")


class NearDuplicates:
    """Classes of equal records and the links between them, for one table.

    Records without words belong to no link. Equal records (the same multiset of words)
    form a class; only its least id, the representative, takes part in the join, so a group
    of copies of any size costs one record. Links are found between representatives.
    """

    def __init__(self, docs: DataFrame, threshold: float = 0.85, recall: float = RECALL):
        self.docs, self.threshold = docs, threshold
        prints, self.trees = fingerprints(docs, recall, threshold)
        self.prints = cut_lineage(prints.where("n > 0"))
        # Equal records have equal facts, so those of the least id are taken.
        self.classes = cut_lineage(self.prints.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
        first = self.prints.select(F.col("id").alias("rep"), "n", *tokens.folded(), "paths")
        self.reps = cut_lineage(first.join(self.classes.select("rep"), "rep"))

    def nodes(self) -> tuple[DataFrame, DataFrame | None]:
        """(rows of small nodes, rows of groups that branching does not separate), with FACTS, node and size.

        A large node is given up to branching only if its children need less than half of
        its comparisons, so the work shrinks with every turn and the loop ends.
        """
        known = self.reps.select(*FACTS)
        level = self.reps.select(*FACTS, F.explode("paths").alias("node"))
        small, tight = [], []
        while True:
            big = cut_lineage(level.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > SMALL))
            if big.limit(1).count() == 0:
                small.append(level)
                break
            small.append(level.join(big, "node", "left_anti").select(*FACTS, "node"))
            members = cut_lineage(level.join(big, "node").select(*FACTS, "node", "size"))
            children = cut_lineage(branches(members.select("rep", "node").join(self.prints.select(F.col("id").alias("rep"), "signs"), "rep")))
            work = children.groupBy("parent", "node").agg(F.count("*").alias("n")).groupBy("parent").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
            pays = F.col("work") < 0.5 * F.col("size").cast("double") * F.col("size")
            judged = cut_lineage(big.join(work, F.col("node") == F.col("parent")).select("node", pays.alias("pays")))
            tight.append(members.join(judged.where("not pays"), "node").select(*FACTS, "node", "size"))
            level = children.join(judged.where("pays").select(F.col("node").alias("parent")), "parent").select("rep", "node").join(known, "rep").select(*FACTS, "node")
        together = lambda frames: frames[0] if len(frames) == 1 else together([frames[0].unionByName(frames[1]), *frames[2:]])
        return together(small), together(tight) if tight else None

    def candidates(self) -> DataFrame:
        """(a, b), a < b: representatives that share a node and can overlap by their sizes and parity bits."""
        small, tight = self.nodes()
        most = lambda x, y: tokens.allowed_difference(F.col(f"{x}.n"), F.col(f"{y}.n"), self.threshold)
        near = (F.col("x.rep") < F.col("y.rep")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(self.threshold - 1e-12))
        near = near & tokens.differ_at_most("x", "y", most("x", "y"))
        both = lambda met: met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        few = both(small.alias("x").join(small.alias("y"), (F.col("x.node") == F.col("y.node")) & near))
        if tight is not None:
            x, y = self_pairs(tight, "node", "size", list(FACTS))
            few = few.unionByName(both(x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x._block") == F.col("y._block")) & near)))
        return tokens.only_near(few.distinct(), self.prints.select(F.col("id").alias("rep"), "n", *tokens.ODDS), most)

    def links(self) -> DataFrame:
        """(a, b, overlap0): the representatives whose overlap reaches the threshold."""
        met = cut_lineage(self.candidates())
        docs = tokens.only_ids(self.docs, "id", met.select("a").unionByName(met.select(F.col("b").alias("a"))))
        left = docs.select(F.col("id").alias("a"), F.col("words").alias("_wa"))
        right = docs.select(F.col("id").alias("b"), F.col("words").alias("_wb"))
        joined = met.join(left, "a").join(right, "b")
        return shared_words(joined, ["_wa"], ["_wb"], ["a", "b"], self.threshold)

    def members(self) -> DataFrame:
        """(rep, id, copies): every record with words and its class."""
        reps = self.classes.select("k1", "k2", "rep", "copies")
        return self.prints.select("k1", "k2", "id").join(reps, ["k1", "k2"]).select("rep", "id", "copies")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), the smaller first: every pair of records that overlap.

        Classes are joined with their members, and with themselves, in blocks, so that a
        class that holds a third of all rows is no single task.
        """
        members = self.members()
        found = self.links().select("a", "b")
        across = with_members(with_members(found, members, "a", "x"), members, "b", "y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        many = members.where("copies > 1").select(F.col("rep").alias("class"), F.col("id").alias("rep"), "copies")
        x, y = self_pairs(many, "class", "copies", ["rep"])
        same = (F.col("x.class") == F.col("y.class")) & (F.col("x._block") == F.col("y._block")) & (F.col("x.rep") < F.col("y.rep"))
        return across.unionByName(x.join(y, same).select(F.col("x.rep").alias("id_a"), F.col("y.rep").alias("id_b")))

    def groups(self, ids: DataFrame) -> DataFrame:
        """(id, group_id, links) for every record of `ids`: the least id of its connected
        group, and with how many other records it overlaps directly."""
        found = cut_lineage(self.links().select("a", "b"))
        sizes = self.classes.select("rep", "copies")
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("near"))
        labels = components(found)
        placed = (
            self.members()
            .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .join(degree.withColumnRenamed("a", "rep"), "rep", "left")
            .select("id", F.coalesce("label", "rep").alias("group_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
        )
        return ids.join(placed, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b).

    Labels spread to neighbours and then jump to their label's label, so chains shrink by
    powers of two; every round ends in a checkpoint, and the rounds end when no label
    changes. Labels only ever fall, so that comes. Without edges the result is empty.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("l"), F.col("label").alias("old"))
        jump = spread.select(F.col("node").alias("t"), F.col("l").alias("tl"))
        new = cut_lineage(spread.join(jump, spread["l"] == jump["t"]).select("node", F.least("l", "tl").alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
