"""Problems 3, 5, 6, 7 and 8 against brute force on small tables."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import catalog, leaks, mixing, neardup, quota, splits, tokens
from quillsift.session import cut_lineage

WORD = re.compile(r"\w+")


def bag(text):
    return collections.Counter(WORD.findall((text or "").lower()))


def overlap(a, b):
    longer = max(sum(a.values()), sum(b.values()))
    return sum((a & b).values()) / longer if longer else 1.0


def corpus(n, seed=1, words=60):
    """Texts of invented words, with copies, re-ordered copies and edits at several rates."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of", "to"] * 30
    made = []
    for k in range(n):
        if made and draw.random() < 0.6:
            text = draw.choice(made).split()
            for _ in range(draw.choice([0, 0, 1, 3, 6, 9, 12, 20])):
                text[draw.randrange(len(text))] = draw.choice([*vocabulary, f"new{k}"])
            if draw.random() < 0.3:
                draw.shuffle(text)
        else:
            text = [draw.choice(vocabulary) for _ in range(draw.randrange(5, words))] + [f"id{k}"]
        made.append(" ".join(text))
    return made


def test_words_and_numbering(spark):
    texts = ["It's a_b A a", "", None, "Ünï ünï 12.5", "x " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", tokens.hashed_words(F.col("t")).alias("w")).orderBy("id").collect()
    assert [len(r.w) for r in rows] == [len(WORD.findall((t or "").lower())) for t in texts]
    assert rows[0].w[2:] and rows[0].w[3] == rows[0].w[4] and rows[3].w[0] == rows[3].w[1]
    ids, row = tokens.numbered(np.array([5, 5, 7, 5], dtype=np.uint64) << np.uint64(40), np.array([0, 3, 4]))
    assert list(row) == [0, 0, 0, 1] and len(set(ids[:3])) == 3 and ids[3] in ids[:3]
    many = np.arange(5000) % 3
    assert len(set(tokens.numbered(many.astype(np.uint64), np.arange(5001))[0])) == 3


def test_counts_hold_all_rows(spark):
    rows = spark.createDataFrame([(k, "a b a") for k in range(300)], "id int, t string").repartition(7)
    words = rows.select(tokens.hashed_words(F.col("t")).alias("w"))
    counts, n = tokens.id_counts(words, ["w"])
    assert n == 300 and counts.sum() == 900 and list(counts[counts > 0]) == [300, 300, 300]
    counts, n = tokens.id_counts(words.limit(0), ["w"])
    assert n == 0 and counts.sum() == 0


def test_counters_are_merged_in_bounded_groups(spark, monkeypatch):
    """At any number of partitions a task merges GROUP blocks at most."""
    assert [tokens.merge_levels(n) for n in (1, 64, 65, 4096, 5000, 800_000)] == [1, 1, 2, 2, 3, 4]
    monkeypatch.setattr(tokens, "GROUP", 3)
    monkeypatch.setattr(tokens, "BLOCKS", 4)
    words = spark.range(0, 40, 1, 20).select(F.array(F.lit(7) * (1 << 40), F.col("id") + 1).alias("w"))
    counts, n = tokens.id_counts(words, ["w"])
    assert n == 40 and counts.sum() == 80 and counts.max() >= 40


def test_parity_bits_never_rule_out_a_near_pair():
    draw = np.random.default_rng(2)
    for size in (1, 5, 40, 300, 2000):
        a = tokens.mix(draw.integers(0, 1 << 62, size).astype(np.uint64))
        for share in (0.85, 0.9, 1.0):
            b = a.copy()
            edited = size - int(np.ceil(share * size - 1e-9))
            b[:edited] = tokens.mix(draw.integers(0, 1 << 62, edited).astype(np.uint64))
            bits = [tokens.parities(x, np.zeros(size, dtype=np.int64), 1) for x in (a, b)]
            differ = sum(bin((int(x[0]) ^ int(y[0])) & (1 << 64) - 1).count("1") for x, y in zip(*bits))
            assert differ <= 2 * edited <= 2 * size - 2 * int(np.ceil(0.85 * size - 1e-9))


DOCS = "row_id bigint, original_instruction string, original_code string, rep bigint, words string, id bigint"


def records(spark, texts):
    rows = [(k, t.split(" ", 1)[0] if t else t, t.split(" ", 1)[1] if t and " " in t else None, 1, "x", None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def brute(texts, threshold=0.85):
    bags = [bag(t) for t in texts]
    return {(i, j) for i in range(len(bags)) for j in range(i + 1, len(bags)) if bags[i] and bags[j] and overlap(bags[i], bags[j]) >= threshold - 1e-12}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = corpus(260, seed) + [None, "", "  ", "one", "one", "Two, two two"]
    docs = neardup.with_words(records(spark, texts), "row_id", ["original_instruction", "original_code"])
    found = [tuple(r) for r in neardup.NearDuplicates(docs).pairs().collect()]
    assert len(found) == len(set(found)) and set(found) == brute(texts)


def test_near_duplicate_groups(spark):
    texts = corpus(150, 5) + [None, "one", "one"]
    docs = neardup.with_words(records(spark, texts), "row_id", ["original_instruction", "original_code"])
    pairs = brute(texts)
    got = {r.id: (r.group_id, r.links) for r in neardup.NearDuplicates(docs).groups(docs.select("id")).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in sorted(pairs):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    links = collections.Counter(k for p in pairs for k in p)
    assert got == {k: (root(k), links[k]) for k in range(len(texts))}


def test_a_third_of_all_rows_are_copies(spark):
    texts = ["alpha beta gamma delta epsilon"] * 60 + corpus(120, 7)
    docs = neardup.with_words(records(spark, texts), "row_id", ["original_instruction", "original_code"])
    join = neardup.NearDuplicates(docs)
    assert {tuple(r) for r in join.pairs().collect()} == brute(texts) and join.classes.count() <= 121


def test_near_duplicates_of_nothing(spark):
    docs = neardup.with_words(records(spark, ["a b"]).limit(0), "row_id", ["original_instruction", "original_code"])
    join = neardup.NearDuplicates(docs)
    assert join.pairs().count() == 0 and join.groups(docs.select("id")).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (100, 102)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_more_trees_for_more_recall():
    assert neardup.trees_for(0.999, 1, 0.85) < neardup.trees_for(0.9999, 1, 0.85) < neardup.trees_for(0.9999, 2, 0.85)


def family(draw, text, names, at):
    """A copy whose words at the given places are new."""
    words = text.split()
    for k in at(len(words)):
        words[k] = draw.choice(names)
    return " ".join(words)


@pytest.mark.parametrize("vocabulary", [60, 150, 400, 100_000])
def test_recall_for_small_and_large_vocabularies(spark, vocabulary):
    """Pairs at the threshold itself, among texts of frequent words; edits bring in rare words only."""
    draw = random.Random(vocabulary)
    base = [" ".join(f"w{draw.randrange(vocabulary)}" for _ in range(40)) for _ in range(6000)]
    pairs = [(k, family(draw, base[k], [f"rare{n}" for n in range(10**6, 10**6 + 50)], lambda n: draw.sample(range(n), 6))) for k in range(600)]
    texts = base + [t for _, t in pairs]
    docs = neardup.with_words(records(spark, texts), "row_id", ["original_instruction", "original_code"])
    found = {tuple(r) for r in neardup.NearDuplicates(docs).links().select("a", "b").collect()}
    want = {(k, 6000 + n) for n, (k, _) in enumerate(pairs)}
    assert len(found & want) >= 0.99 * len(want)


def test_a_large_family_of_near_copies(spark, monkeypatch):
    """Branching cannot separate it; it is compared in blocks, and none of its links is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 50)
    draw = random.Random(8)
    core = " ".join(f"c{k}" for k in range(60))
    texts = [family(draw, core, [f"e{k}x{n}" for n in range(9)], lambda n: [draw.randrange(n)]) for k in range(300)] + corpus(200, 3)
    docs = neardup.with_words(records(spark, texts), "row_id", ["original_instruction", "original_code"])
    join = neardup.NearDuplicates(docs)
    assert join.nodes()[1] is not None
    assert {tuple(r) for r in join.pairs().collect()} == brute(texts)


PREFS = "pref_id bigint, prompt array<struct<role:string,content:string>>, chosen array<struct<role:string,content:string>>, split_name string, id bigint, side string"


def test_cross_split(spark):
    draw = random.Random(4)
    prompts, chosen = corpus(200, 11), corpus(200, 12)
    rows = []
    for k in range(200):
        other = draw.randrange(k + 1) if draw.random() < 0.5 else k
        system = [("system", f"be {k}")] if k % 3 == 0 else []
        rows.append((k, [*system, ("user", prompts[other])], [("assistant", chosen[other])] if draw.random() < 0.9 else [("assistant", chosen[k])], draw.choice(["train", "train", "eval", "test"]), None, "x"))
    rows += [(500, None, None, "train", None, None), (501, None, None, "eval", None, None), (502, [("user", None)], [("assistant", "")], "test", None, None), (503, [("user", "p q r")], None, "train", None, None), (504, [("user", "p q r")], [], "eval", None, None), (505, None, None, None, None, None), (506, [(None, "p q r")], [], "valid", None, None)]
    table = spark.createDataFrame(rows, PREFS)
    text = lambda m: bag("\n".join(c or "" for r, c in m or [] if r != "system"))
    want = set()
    for a in rows:
        for b in rows:
            if a[3] == "train" and b[3] in ("eval", "test") and (text(a[1]) or text(a[2])) and overlap(text(a[1]), text(b[1])) >= 0.85 - 1e-12 and overlap(text(a[2]), text(b[2])) >= 0.85 - 1e-12:
                want.add((a[0], b[0]))
    join = splits.CrossSplit(splits.split_records(table))
    got = [tuple(r) for r in join.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want and (503, 504) in want
    counts = collections.Counter(b for _, b in want)
    leaked = {r.id: r.training_records for r in join.leaked().collect()}
    assert leaked == dict(counts)
    empty = splits.CrossSplit(splits.split_records(table.limit(0)))
    assert empty.pairs().count() == 0


def test_hot_terms_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(splits, "HOT", 20)
    monkeypatch.setattr(splits, "BLOCK", 3)
    draw = random.Random(6)
    common = [f"w{k}" for k in range(12)]
    texts = [" ".join(draw.choice(common) for _ in range(20)) for _ in range(150)]
    texts += [family(draw, texts[k], common, lambda n: draw.sample(range(n), 2)) for k in range(60)]
    side = [draw.choice(["train", "eval"]) for _ in texts]
    table = spark.createDataFrame([(k, [("user", "p q r")], [("assistant", t)], side[k], None, None) for k, t in enumerate(texts)], PREFS)
    bags = [bag(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if side[i] == "train" and side[j] == "eval" and overlap(bags[i], bags[j]) >= 0.85 - 1e-12}
    got = [tuple(r) for r in splits.CrossSplit(splits.split_records(table)).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_the_index_bound_by_brute_force():
    """The least product that two near records can have is tau; the terms left out cannot reach it."""
    draw = np.random.default_rng(5)
    for _ in range(200):
        sizes = draw.integers(0, 7, 2)
        fields = np.repeat([0, 1], sizes)
        squares = draw.random(len(fields)) ** 2
        order = np.argsort(squares)
        taken, tau, rest = splits.index_start(squares[order], fields[order], np.zeros(len(fields), dtype=np.int64), np.array([0, len(fields)]), [sizes[:1], sizes[1:]], 0.85)
        least = sum(sorted(squares[fields == f])[k] for f in (0, 1) for k in range(int(np.ceil(0.85 * sizes[f] - 1e-9))))
        assert tau[0] == pytest.approx(least) and rest[0] == pytest.approx(squares[order][~taken].sum()) and (rest[0] < tau[0] or not len(fields))


def test_leaks(spark):
    draw = random.Random(9)
    items = [" ".join(draw.choice([f"v{k}" for k in range(80)]) for _ in range(45)) for _ in range(25)] + ["short item", "", None]
    docs = []
    for k in range(200):
        filler = [draw.choice([f"f{j}" for j in range(50)]) for _ in range(20)]
        source = items[draw.randrange(25)].split()
        size, at = draw.choice([3, 8, 11, 12, 13, 30]), draw.randrange(15)
        part = source[at : at + size]
        docs.append(" ".join(filler[:10]) + " " + ("!, ".join(part).upper() if k % 2 else "\n".join(part)) + " " + " ".join(filler[10:]))
    docs += [None, "", "one two", items[0], items[0], "z " * 30_000 + items[1]]
    table = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").select("id", tokens.hashed_words(F.col("t")).alias("words"))
    grams = collections.defaultdict(set)
    for j, t in enumerate(items):
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add(j)
    want = {(i, j) for i, t in enumerate(docs) for w in [WORD.findall((t or "").lower())] for k in range(len(w) - 11) for j in grams.get(tuple(w[k : k + 12]), ())}
    got = [tuple(r) for r in leaks.leaks(table(docs), table(items)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leaks.leaks(table(docs).limit(0), table(items)).count() == 0 and leaks.leaks(table(docs), table(items).limit(0)).count() == 0


def score(a, b, points=leaks.EDITED):
    """One alignment score of two word lists."""
    number = {w: k + 1 for k, w in enumerate(dict.fromkeys([*a, *b]))}
    return leaks.smith_waterman([np.array([number[w] for w in x], dtype=np.uint64) for x in (a,)], [np.array([number[w] for w in b], dtype=np.uint64)], points)[0]


@pytest.mark.parametrize("every", [8, 10])
def test_copies_edited_more_often_than_a_run(spark, tmp_path, every):
    """Every stretch of 12 words holds an edit, so most of its shingles stand in no text, or only in one that is no copy."""
    draw = random.Random(every)
    items = [[f"i{j}w{draw.randrange(300)}" for _ in range(60)] for j in range(4)]
    copies = [(j, " ".join(f"e{j}x{k}x{n}" if n % every == 3 else w for n, w in enumerate(items[j]))) for j in range(4) for k in range(3)]
    decoys = [" ".join([*items[0][n : n + 5], *[f"d{n}x{k}" for k in range(40)]]) for n in range(56) if any(m % every == 3 for m in range(n, n + 5))]
    spark.createDataFrame(list(enumerate([t for _, t in copies] + decoys)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark_items.parquet"))
    want = collections.Counter(j for j, t in copies if score(t.split(), items[j]) >= leaks.SIMILAR * 120)
    assert {r.item_id: (r.exact, r.edited) for r in catalog.p7_items(spark, str(tmp_path)).collect()} == {j: (0, n) for j, n in want.items()} and len(want) == 4


def test_leaks_beyond_the_broadcast_bound(spark, monkeypatch):
    table = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").select("id", tokens.hashed_words(F.col("t")).alias("words"))
    item = " ".join(f"a{k}" for k in range(30))
    docs = ["x y " + item + " z", "nothing", " ".join(item.split()[:11])]
    few = leaks.leaks(table(docs), table([item])).collect()
    monkeypatch.setattr(leaks, "BROADCAST_SHINGLES", 3)
    assert leaks.leaks(table(docs), table([item])).collect() == few == [(0, 0)]


def test_alignment_scores():
    a = list(range(20))
    edited = [*a[:9], 99, *a[9:]]
    assert score(a, a) == 40 and score(edited, a) == 39 and score([x + 100 for x in a], a) == 0
    assert score(edited, a, leaks.EXACT) == 22 and leaks.smith_waterman([np.zeros(0, np.uint64)], [np.arange(3, dtype=np.uint64)])[0] == 0

    def slow(x, y, mismatch, gap):
        h = np.zeros((len(x) + 1, len(y) + 1))
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else mismatch), h[i - 1, j] + gap, h[i, j - 1] + gap)
        return h.max()

    draw = np.random.default_rng(1)
    texts = [draw.integers(0, 6, draw.integers(0, 40)).astype(np.uint64) for _ in range(60)]
    items = [draw.integers(0, 6, draw.integers(0, 18)).astype(np.uint64) for _ in range(60)]
    for points in (leaks.EDITED, leaks.EXACT):
        assert list(leaks.scores(texts, items, points)) == [slow(x, y, *points[1:]) for x, y in zip(texts, items)]


TREE = {1: (10, 100), 2: (10, 100), 3: (10, 101), 4: (11, 102)}


def test_allocation_passes_to_siblings_then_cousins():
    share, none = {1: 40, 2: 20, 3: 20, 4: 20}, dict.fromkeys([1, 2, 3, 4], 0)
    assert quota.allocate(25, share, none, {1: 4, 2: 30, 3: 30, 4: 30}, TREE) == {1: 4, 2: 11, 3: 5, 4: 5}
    assert quota.allocate(25, share, none, {1: 4, 2: 7, 3: 30, 4: 30}, TREE) == {1: 4, 2: 7, 3: 9, 4: 5}
    assert quota.allocate(25, share, none, {1: 0, 2: 5, 3: 6, 4: 30}, TREE) == {1: 0, 2: 5, 3: 6, 4: 14}
    assert quota.allocate(3, {1: 100}, {1: 1}, {}, TREE) == {1: 0} and quota.allocate(0, share, none, {1: 9}, TREE) == none
    assert quota.allocate(10, {1: 100, 5: 0}, {1: 0, 5: 3}, {1: 20, 5: 20}, TREE) == {1: 7, 5: 3}


def test_allocation_has_the_exact_size_and_keeps_its_bounds():
    draw = random.Random(2)
    for _ in range(400):
        cats = draw.sample([*quota.TREE, 5000, 5001], draw.randrange(1, 20))
        weights = [draw.choice([0, 1, 1, 2, 5, 20]) for _ in cats]
        percent = dict(zip(cats, weights))
        least, have, size = {c: draw.choice([0, 0, 1, 2, 8]) for c in cats}, {c: draw.choice([0, 1, 5, 40, 300]) for c in cats}, draw.randrange(0, 400)
        got = quota.allocate(size, percent, least, have)
        assert sum(got.values()) == min(size, sum(have.values())) and all(0 <= got[c] <= have[c] for c in cats)
        floor = {c: min(least[c], have[c]) for c in cats}
        assert sum(floor.values()) > size or all(got[c] >= floor[c] for c in cats)


SPELLED = ["CWE-79", "cwe-79", "79", "CWE_0079", " CWE 79 ", "CWE-89", None, "", " ", "none"]


def test_quota(spark):
    meta = "struct<row_index:bigint,source:string,lang:string,cwe:string,benign:string,pair_rule:string>"
    rows = [(k, (k % 5 if k % 2 else None, "s", "l", SPELLED[k % 10], "b", "p"), None) for k in range(400)] + [(900, None, "x")]
    prefs = spark.createDataFrame(rows, f"pref_id bigint, metadata {meta}, category string")
    sources = spark.createDataFrame([(0, "CWE-22"), (1, None), (2, "x"), (3, "022"), (4, "CWE-79")], "row_id bigint, cwe string")
    targets = spark.createDataFrame([("CWE-79", 30, 2), ("CWE-89", 40, 2), ("CWE-22", 25, 2), ("CWE-1333", 5, 2)], "cwe string, target_pct int, min_rows int")
    named = {0: 22, 3: 22, 4: 79}
    own = lambda m: None if m is None else (int(re.search(r"\d+", m[3]).group()) if m[3] and re.search(r"\d", m[3]) else named.get(m[0]) if not (m[3] or "").strip() else None)
    placed = quota.categories(prefs, sources)
    assert {r.pref_id: r.category for r in placed.collect()} == {r[0]: own(r[1]) for r in rows}
    planned = quota.plan(prefs, placed, targets)
    have = collections.Counter(own(r[1]) for r in rows)
    for r in planned.collect():
        assert r.need == max(-(-r.target_pct * 200 // 100), r.min_rows) and r.available == have[r.category] and r.short == (r.available < r.need)
    drawn = [(r.pref_id, r.category) for r in quota.draw(placed, planned).collect()]
    assert len(set(drawn)) == len(drawn) and all(own(dict((x[0], x[1]) for x in rows)[i]) == c for i, c in drawn)
    assert collections.Counter(c for _, c in drawn) == {r.category: r.draw for r in planned.collect() if r.draw}
    assert sorted(drawn) == sorted((r.pref_id, r.category) for r in quota.draw(placed.repartition(5), planned).collect())
    assert len(drawn) == min(len(rows) // 2, sum(r.available for r in planned.collect()))
    none = quota.plan(prefs.limit(0), placed.limit(0), targets)
    assert quota.draw(placed.limit(0), none).count() == 0


MIX = "doc_id bigint, source string, text string, tokens string, n string"


def test_mixing(spark):
    rows = [(k, ["a", "b", "c", None][k % 4], "some words here " * (1 + k % 3), "x", None) for k in range(4000)] + [(9000, "a", None, None, None), (9001, "a", "", None, None), (9002, "d", "<|endoftext|> é", None, None)]
    counted = cut_lineage(mixing.with_tokens(spark.createDataFrame(rows, MIX)))
    sizes = {r.source: r.s for r in counted.groupBy("source").agg(F.sum("tokens").alias("s")).collect()}
    assert counted.where("doc_id in (9000, 9001)").agg(F.sum("tokens")).collect()[0][0] == 0
    targets = spark.createDataFrame([("a", 20, 1), ("b", 60, 3), ("c", 10, 2), ("e", 10, 2)], "source string, target_pct int, max_repeats int")
    plan = {r.source: r for r in mixing.rates(mixing.sizes(counted), targets).collect()}
    total = sum(sizes.values())
    assert [s for s, r in plan.items() if r.short] == ["e"] and plan["e"].rate == 0 and plan["b"].rate == pytest.approx(0.6 * total / sizes["b"])
    mix = mixing.mixed(counted, mixing.rates(mixing.sizes(counted), targets)).collect()
    assert len({(r.doc_id, r.copy) for r in mix}) == len(mix) and max(r.copy for r in mix) <= 3
    got = collections.Counter()
    for r in mix:
        got[r.source] += r.tokens
    assert got["b"] / total == pytest.approx(0.6, abs=0.02) and got["a"] / total == pytest.approx(0.2, abs=0.02)
    whole = collections.Counter(r.doc_id for r in mix if r.source == "b")
    assert set(whole.values()) <= {2, 3}
    assert {r.source for r in mixing.report(mixing.mixed(counted, mixing.rates(mixing.sizes(counted), targets)), mixing.rates(mixing.sizes(counted), targets)).collect()} == {"a", "b", "c", "e"}
    assert mixing.mixed(counted.limit(0), mixing.rates(mixing.sizes(counted.limit(0)), targets)).count() == 0
