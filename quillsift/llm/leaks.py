"""Problem 7: passages of evaluation texts inside a corpus.

Five-word shingles of the items are looked up in the whole corpus. For exact leaks the
rarest shingle in every stretch of `run` words of an item is a seed, so a text that holds
such a stretch holds a seed; for edited copies every shingle is one, because edits break
the shingles around them and any other may be all that is left. Texts and items that share
a seed are aligned by Smith-Waterman, many pairs at a time. Without gaps and mismatches
the alignment is the longest passage that both hold, and its score decides exact leaks;
with both allowed at a price it finds edited and paraphrased copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import tokens
from quillsift.session import cut_lineage

SHINGLE = 5
#: Item shingles up to this number (4 MB) are broadcast to filter the corpus; beyond it they are joined.
BROADCAST_SHINGLES = 500_000
#: Keys over which a seed of many texts is spread when shingles are joined.
SALTS = 32
#: Smith-Waterman score, as a share of the shorter text's best possible score, from which a copy counts as edited.
SIMILAR = 0.8
#: Points of an alignment: (match, mismatch, gap). EXACT allows neither mismatch nor gap.
EDITED, EXACT = (2.0, -1.0, -1.0), (2.0, -np.inf, -np.inf)
#: Cells of one row of the alignments that are computed together.
CELLS = 1 << 18


def shingles(values: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position) of every shingle inside the rows of a flat array."""
    size = len(values) - width + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    with np.errstate(over="ignore"):
        h = np.zeros(size, dtype=np.uint64)
        for k in range(width):
            h = tokens.mix(h * np.uint64(31) + values[k : k + size])
    inside = rows[:size] == rows[width - 1 :]
    at = np.flatnonzero(inside)
    return h[at], rows[at], at - offsets[rows[at]]


def _shingle_rows(docs: DataFrame, kept: np.ndarray | None, position: bool) -> DataFrame:
    """(id, gram[, pos]) of the distinct shingles of `docs` (id, words), kept only if in `kept`."""
    names = [("id", pa.int64()), ("gram", pa.int64())] + ([("pos", pa.int32())] if position else [])
    schema = pa.schema(names)
    held = docs.sparkSession.sparkContext.broadcast(kept) if kept is not None else None

    def run(batches):
        wanted = held.value if held else None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                values, offsets = tokens.flat(part.column(1))
                gram, row, pos = shingles(values, offsets)
                if wanted is not None and len(gram):
                    near = np.minimum(np.searchsorted(wanted, gram), max(len(wanted) - 1, 0))
                    hit = wanted[near] == gram if len(wanted) else np.zeros(len(gram), bool)
                    gram, row, pos = gram[hit], row[hit], pos[hit]
                if not position and len(gram):
                    order = np.lexsort((gram, row))
                    gram, row = gram[order], row[order]
                    new = np.ones(len(gram), bool)
                    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
                    gram, row = gram[new], row[new]
                columns = [part.column(0).take(pa.array(row)), pa.array(gram.view(np.int64))] + ([pa.array(pos.astype(np.int32))] if position else [])
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("id", "words").mapInArrow(run, ", ".join(f"{n} {'int' if n == 'pos' else 'bigint'}" for n, _ in names))


def seeds(items: DataFrame, counts: DataFrame, run: int) -> DataFrame:
    """(gram, item): the rarest shingle of every stretch of `run` words of an item.

    Complete for exact runs alone: a stretch with a shingle that no text holds stands in no text.
    """
    grams = _shingle_rows(items, None, True).join(counts, "gram", "left").select("id", "gram", "pos", F.coalesce("often", F.lit(0)).alias("often"))
    schema = pa.schema([("gram", pa.int64()), ("item", pa.int64())])
    per = max(1, run - SHINGLE + 1)

    def pick(table: pa.Table) -> pa.Table:
        t = table.sort_by([("pos", "ascending")])
        gram, often = np.asarray(t.column("gram")), np.asarray(t.column("often"))
        chosen = set()
        for k in range(max(1, len(gram) - per + 1)):
            window = np.lexsort((gram[k : k + per], often[k : k + per]))
            chosen.add(int(gram[k + window[0]]))
        return pa.Table.from_arrays([pa.array(sorted(chosen), pa.int64()), pa.array([t.column("id")[0].as_py()] * len(chosen), pa.int64())], schema=schema)

    return grams.groupBy("id").applyInArrow(pick, "gram bigint, item bigint")


def smith_waterman(texts: list[np.ndarray], items: list[np.ndarray], points: tuple[float, float, float] = EDITED) -> np.ndarray:
    """Local alignment scores over words of pairs (texts[k], items[k]), all pairs a row at a time.

    Gaps along a row are a running maximum. Texts and items are filled up with signs that
    match nothing.
    """
    match, mismatch, gap = points
    n, wide, high = len(texts), max(map(len, texts), default=0), max(map(len, items), default=0)
    best = np.zeros(n)
    if not n or not wide or not high:
        return best
    words, known = np.zeros((n, wide), dtype=np.uint64), np.zeros((n, wide), dtype=bool)
    rows, there = np.zeros((high, n), dtype=np.uint64), np.zeros((high, n), dtype=bool)
    for k, (a, b) in enumerate(zip(texts, items)):
        words[k, : len(a)], known[k, : len(a)] = a, True
        rows[: len(b), k], there[: len(b), k] = b, True
    last = np.zeros((n, wide + 1))
    slope = -gap * np.arange(wide) if np.isfinite(gap) else None
    for word, live in zip(rows, there):
        same = (words == word[:, None]) & known & live[:, None]
        now = np.maximum(0.0, np.where(same, last[:, :-1] + match, last[:, :-1] + mismatch if np.isfinite(mismatch) else 0.0))
        if slope is not None:
            now = np.maximum(now, last[:, 1:] + gap)
            now = np.maximum.accumulate(now + slope, axis=1) - slope
        best = np.maximum(best, now.max(axis=1))
        last[:, 1:] = now
    return best


def scores(texts: list[np.ndarray], items: list[np.ndarray], points: tuple[float, float, float]) -> np.ndarray:
    """`smith_waterman` of any number of pairs, in batches of similar length and bounded size."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    while order:
        some, wide = [order.pop()], 0
        wide = len(texts[some[0]]) + 1
        while order and (len(some) + 1) * wide <= CELLS and 2 * (len(texts[order[-1]]) + 1) >= wide:
            some.append(order.pop())
        out[some] = smith_waterman([texts[k] for k in some], [items[k] for k in some], points)
    return out


def alignments(docs: DataFrame, items: DataFrame, run: int = 12, edited: bool = True) -> DataFrame:
    """(id, item, run, score) for the texts and items that share a seed.

    `docs` and `items` have id and words. run is the score of the alignment without gaps and
    mismatches, in words. score is that of the alignment with both, over the best score the
    shorter of the two could reach, or NULL without `edited`. With `edited` every shingle is
    a seed, otherwise only those that exact runs need. Pairs whose words in any order rule
    out both a run of `run` words and the score SIMILAR are left out. Texts shorter than a
    shingle share no seed. Repeated texts are aligned each.

    The corpus is cut into shingles once; what it shares with the items is written down. A
    seed of any number of texts is broadcast with the items, or joined over SALTS keys.
    """
    grams = _shingle_rows(items, None, False)
    item_grams = grams.select("gram").distinct()
    # All shingles of all items are counted, so the bound holds for the seeds with their items too.
    some = grams.select("gram").limit(BROADCAST_SHINGLES + 1).toArrow().column("gram")
    few = len(some) <= BROADCAST_SHINGLES
    kept = np.unique(np.asarray(some, dtype=np.int64).view(np.uint64)) if few else None
    hits = _shingle_rows(docs, kept, False)
    if not few:
        hits = _salted(hits, item_grams, "left_semi")
    if edited:
        chosen = grams.withColumnRenamed("id", "item")
    else:
        hits = cut_lineage(hits)
        chosen = seeds(items, hits.groupBy("gram").agg(F.count("*").alias("often")), run)
    pairs = (hits.join(F.broadcast(chosen), "gram") if few else _salted(hits, chosen, "inner")).select("id", "item").distinct()
    both = pairs.join(docs.select("id", F.col("words").alias("_a")), "id").join(items.select(F.col("id").alias("item"), F.col("words").alias("_b")), "item")
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("run", pa.int32()), ("score", pa.float64())])

    def align(batches):
        for batch in batches:
            va, oa = tokens.flat(batch.column(2))
            vb, ob = tokens.flat(batch.column(3))
            texts, parts, at = [], [], []
            for k in range(batch.num_rows):
                a, b = va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]]
                most = min(int(np.isin(a, b).sum()), int(np.isin(b, a).sum()))
                if most >= run or edited and most >= SIMILAR * min(len(a), len(b)) - 1e-9:
                    at.append(k)
                    texts.append(a)
                    parts.append(b)
            runs = (scores(texts, parts, EXACT) / EXACT[0]).astype(np.int32)
            best = [max(1.0, EDITED[0] * min(len(a), len(b))) for a, b in zip(texts, parts)]
            score = pa.array(scores(texts, parts, EDITED) / np.array(best) if edited else [None] * len(at), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)], pa.array(runs), score], schema=schema)

    return both.select("id", "item", "_a", "_b").mapInArrow(align, "id bigint, item bigint, run int, score double")


def _salted(hits: DataFrame, grams: DataFrame, how: str) -> DataFrame:
    """A join on gram with the hits of each spread over SALTS keys."""
    salted = hits.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(grams.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["gram", "_salt"], how).drop("_salt")


def leaks(docs: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """(id, item): the text holds at least `run` words of the item in unbroken succession."""
    return alignments(docs, items, run, edited=False).where(F.col("run") >= run).select("id", "item")
