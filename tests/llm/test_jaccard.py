"""Operator 5 against all pairs by brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import jaccard, queries
from tidemark.llm.common import Scratch


def word_sets(rows, n):
    out = {}
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        out[doc] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, n, percent):
    sets = word_sets(rows, n)
    root, where = {i: i for i in sets}, defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        shared = Counter(j for x in sets[i] for j in where[x])
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in sets[i]:
            where[x].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def mutated(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def collection(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, doc = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 11, 12, 40, 150, 400]))] + passage * rng.randrange(2)
        for _ in range(rng.choice([1, 1, 2, 3, 30])):
            rows.append((doc, mutated(base, rng, rng.choice([0, 0, 1, 1, 2, 5]))))
            doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 1, 60)])
def test_equals_all_pairs(spark, seed, n, percent):
    rows = collection(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_ngram_jaccard_join(spark, sf).collect()}
    assert got == brute(rows, 3, 90)


def test_defined_cases(spark):
    same = "One  two\tthree four five six seven eight nine ten eleven twelve"
    rows = [(5, same), (3, same.upper()), (3, same.upper()), (None, same), (7, None), (8, ""), (9, " \n"), (1, "a b"), (2, "A\nb"), (4, "b a"), (6, "É b"), (10, "é b")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, n_shingles int, component_id int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.join(docs, 3, 90).collect())
    assert got == sorted([(5, 10, 3), (3, 10, 3), (3, 10, 3), (-1, 10, None), (7, 0, 7), (8, 0, 8), (9, 0, 9), (1, 1, 1), (2, 1, 1), (4, 1, 4), (6, 1, 6), (10, 1, 10)])
    assert jaccard.join(docs.limit(0), 3, 90).count() == 0


def test_levels_follow_cost():
    """Tokens that stand everywhere make a document ask for more shared ones; rare ones do not."""
    tokens = np.unique(np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64))
    rare, common = np.ones(jaccard.SKETCH, dtype=np.int64), np.full(jaccard.SKETCH, 50_000)
    assert jaccard.prefix(tokens, rare, 1.0, 90)[0] == 1
    level, kept = jaccard.prefix(tokens, common, 1.0, 90)
    assert level > 1 and len(kept) == len(tokens) - -(-90 * len(tokens) // 100) + level


def run(spark, rows, n, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, n, percent).collect()}


@pytest.mark.parametrize(("size", "more", "n", "percent"), [(104, 20, 5, 80), (102, 11, 3, 90), (404, 99, 5, 80)])
def test_appended_paragraph(spark, size, more, n, percent):
    """The longer document's prefix ends among its own words; much of the other's prefix stands in it further on."""
    words = [f"w{i}" for i in range(size)]
    added = words + [f"a{i}" for i in range(more)]
    rows = [(1, " ".join(words)), (2, " ".join(added))]
    got = run(spark, rows, n, percent)
    assert got == brute(rows, n, percent) and got[2][1] == 1


@pytest.mark.parametrize(("seed", "n", "percent", "others"), [(1, 5, 80, 0), (2, 3, 90, 0), (3, 5, 80, 3000)])
def test_appended_and_removed(spark, seed, n, percent, others):
    """Sizes and levels differ within pairs: passages that stand in hundreds of documents, words put at or cut from an end.

    With the others, the table has more tokens than the sketch has counters."""
    rng = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(120)] for k in range(3)]
    rows, doc = [], 0
    for g in range(150):
        base = [f"g{g}x{i}" for i in range(rng.choice([10, 40, 100]))] + passages[g % 3][: rng.choice([0, 60, 120])]
        for _ in range(rng.choice([2, 2, 3])):
            k = round(len(base) * rng.choice([0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.24]))
            own = [f"d{doc}x{i}" for i in range(k)]
            rows.append((doc, " ".join(rng.choice([base + own, own + base, base[k:], base[: len(base) - k]]))))
            doc += 1
    rows += [(doc + i, " ".join(f"o{rng.randrange(10**7)}" for _ in range(150))) for i in range(others)]
    assert run(spark, rows, n, percent) == brute(rows, n, percent)


def test_one_id_with_several_texts(spark):
    """Nodes are texts: each row has the component of its own text."""
    base, other = ([f"{k}{i}" for i in range(100)] for k in "ab")
    texts = [(1, base), (1, other), (2, [*base, "x"]), (3, [*other, "x"]), (4, [f"c{i}" for i in range(50)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(docs, 5, 80).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    kept = sorted((r.doc_id, r.text) for r in jaccard.representatives(docs.union(docs.where("doc_id = 1")), 5, 80).collect())
    assert kept == sorted([(1, " ".join(base)), (1, " ".join(other)), (4, " ".join(texts[4][1]))])
    same = spark.createDataFrame([(9, " ".join(base)), (9, " ".join([*base, "x"])), (9, None), (9, ""), (None, " ".join(base)), (12, " ".join(["y", *base]))], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), (r.text or "")[:2]) for r in jaccard.representatives(same, 5, 80).collect()) == [(-1, "a0"), (9, ""), (9, "a0")]


def test_token_in_all_documents(spark):
    """A passage in every document, of many sizes around it: links only where sizes and the rest allow."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = [f"g{i // 2}x{k}" for k in range(rng.choice([1, 4, 10, 15, 30, 200]) if i % 2 == 0 else len(rows[-1][1].split()) - 60)]
        rows.append((i, " ".join(passage + own)))
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_long_text(spark):
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, " ".join(words[:100_000]))]
    assert {i: c for i, (_, c) in run(spark, rows, 5, 80).items()} == {1: 1, 2: 1, 3: 3}


def test_tokens_above_the_noise_of_the_sketch_come_last():
    tokens = np.arange(1, 101, dtype=np.uint64) << np.uint64(40) | np.arange(1, 101, dtype=np.uint64)
    counts = np.full(jaccard.SKETCH, 400, dtype=np.int64)
    counts[1:31] = 450  # 2.5 times the root of the usual counter above it
    kept = jaccard.prefix(tokens, counts, 400.0, 60)[1]
    assert len(kept) == 41 and not set(kept.tolist()) & set(tokens[:30].tolist())


def test_whole_sets_meet_only_of_pairs_whose_signatures_are_near(spark):
    """Of two pairs with a common document one cannot be similar enough: its sets stay where they are. Repeated rows change nothing."""

    class Kept(Scratch):
        def table(self, df, partitions=None):
            out = super().table(df, partitions)
            counts.append((set(out.columns), out.count()))
            return out

    counts: list[tuple[set[str], int]] = []
    base = [f"w{i}" for i in range(200)]
    texts = [(1, base), (2, [*base, "x"]), (3, base[:100] + [f"y{i}" for i in range(100)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    nodes = jaccard.with_set_key(docs, 3).selectExpr("doc_id as node", "doc_id", "set_key")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    for rows in (docs, docs.union(docs.where("doc_id < 3"))):
        counts.clear()
        assert [tuple(r)[:2] for r in jaccard._verified(pairs, nodes, rows, 3, 90, Kept(spark)).collect()] == [(1, 2)]
        assert [n for columns, n in counts if {"ka", "size_a"} <= columns] == [1]


@pytest.mark.parametrize("size", [3, 500, 20_000])
def test_signatures_never_tell_more_than_what_lacks(size):
    rng = np.random.default_rng(size)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    b = np.unique(np.r_[a[: 4 * len(a) // 5], rng.integers(0, 2**63, size // 3).astype(np.uint64)])
    bits = [np.unpackbits(jaccard.signature(x).view(np.uint8)) for x in (a, b)]
    for i, (x, y) in enumerate(((a, b), (b, a))):
        assert int((bits[i] & ~bits[1 - i] & 1).sum()) <= len(np.setdiff1d(x, y))
