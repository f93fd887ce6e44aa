"""Operators 1 and 2 against brute force."""

import numpy as np
import pytest

from tidemark.llm import ann, queries, vector_dedup
from tidemark.llm.ann import F

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def near_copies(seed, n=600):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 24))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 24))
    x[100:250] = x[0] + rng.normal(size=(150, 24)) * rng.choice([0.02, 0.1, 0.16], (150, 1))
    x[300:330] = x[299]
    return x.astype(np.float32)


def frame(spark, x, labels):
    odd = [(100_000, None, 0), (100_001, [0.0] * 24, 0), (100_002, [float("nan")] * 24, 0), (100_003, [None] * 24, 0), (100_004, [float("inf")] * 24, 0), (None, x[0].tolist(), 0), (100_005, x[0].tolist(), None)]
    rows = [(i * 5, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    return spark.createDataFrame([(*r, "s", 1) for r in rows + odd], SCHEMA).repartition(5)


def brute_links(x, labels, radius=0.98):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= radius) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(linked, comp[None, :], len(x)).min(axis=1))
        if (new == comp).all():
            return linked.sum(axis=1), comp
        comp = new


@pytest.mark.parametrize("shard_rows", [2048, 64])
def test_dedup_equals_all_pairs(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", shard_rows)
    x = near_copies(3)
    labels = np.arange(len(x)) % 50 // 25
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(frame(spark, x, labels)).collect() if r.vec_id is not None}
    links, comp = brute_links(x, labels)
    for i in range(len(x)):
        r = got[i * 5]
        assert (r.n_links, r.component_id, r.kept) == (links[i], comp[i] * 5, comp[i] == i)
    for i in range(100_000, 100_006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_dedup_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_dedup.near_duplicates(empty).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "", 0) for i in range(40)] + [(50, [2.0, 4.0], 1, "", 0), (7, [1.0, 2.0], 1, "", 0)], SCHEMA)
    got = vector_dedup.near_duplicates(same).collect()
    assert len(got) == 42 and {(r.n_links, r.component_id) for r in got} == {(40, 0)}


def test_search_recall_and_scores(spark):
    x = near_copies(5, 3000)
    df = frame(spark, x, np.zeros(len(x), dtype=int))
    got = ann.search(df, F.col("vec_id") % 50 == 0, 5).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    x64 = x.astype(np.float64)
    hits, asked = 0, [i for i in range(len(x)) if i * 5 % 50 == 0]
    near = u @ u.T
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        a, b = x64[r.query_id // 5], x64[r.vec_id // 5] if r.vec_id < 100_000 else x64[0]
        assert r.query_id != r.vec_id and abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert len(by) >= len(asked) - 1
    for i in asked:
        rows = sorted(by[i * 5], key=lambda r: r.rank)
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and all((-a.score, a.vec_id) <= (-b.score, b.vec_id) for a, b in zip(rows, rows[1:], strict=False))
        near[i, i] = -9
        least = np.sort(near[i])[-5]
        hits += sum(r.score >= least - 1e-9 for r in rows)
    assert hits / (5 * len(asked)) >= 0.9


def test_equal_vectors_and_few_rows(spark):
    rows = [(i, [1.0, 0.0], 0, "", 0) for i in range(0, 300)] + [(1000, [0.0, 1.0], 0, "", 0)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, 5).collect()
    for q in range(0, 300, 50):
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for i in range(7) if i != q][:5]
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, "", 0), (1, [1.0, 1.0], 0, "", 0), (50, None, 0, "", 0)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(few, F.col("vec_id") % 50 == 0, 5).collect()] == [(0, 1, 1)]
    assert ann.search(few.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_whole_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.array(df.embedding.tolist(), dtype=np.float32)
    links, comp = brute_links(x, df.label.to_numpy())
    got = queries.op2_vector_dedup(spark, sf).toPandas().set_index("vec_id").loc[df.vec_id]
    assert (got.n_links.to_numpy() == links).all() and (got.component_id.to_numpy() == df.vec_id.to_numpy()[comp]).all()
    found = queries.op1_nearest_neighbours(spark, sf).toPandas()
    assert found.groupby("query_id").size().eq(5).all() and set(found.query_id) == set(df.vec_id[df.vec_id % 50 == 0])


def test_unequal_vectors_under_one_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (2, [1.0, 0.01, 0.0]), (3, [0.01, 1.0, 0.0]), (9, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (9, 0, 9, True)]
    found = ann.search(df, F.col("vec_id") == 1, 2).collect()
    assert all(r.vec_id != 1 for r in found) and len(found) == 2


def test_dedup_over_many_real_shards(spark, monkeypatch):
    """Several thousand vectors over ten shards and more, links across their borders included."""
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", 400)
    x = near_copies(7, 4500)
    labels = np.zeros(len(x), dtype=int)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(frame(spark, x, labels)).collect() if r.vec_id is not None}
    links, comp = brute_links(x, labels)
    assert [(got[i * 5].n_links, got[i * 5].component_id) for i in range(len(x))] == [(links[i], comp[i] * 5) for i in range(len(x))]


def test_search_does_not_depend_on_parts(spark, monkeypatch):
    x = near_copies(11, 900)
    df = frame(spark, x, np.zeros(len(x), dtype=int))
    whole = sorted(map(tuple, ann.search(df, F.col("vec_id") % 10 == 0, 5).collect()))
    monkeypatch.setattr(ann, "QUERY_ROWS", 40)
    monkeypatch.setattr(ann, "SLICE", 7)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    assert sorted(map(tuple, ann.search(df, F.col("vec_id") % 10 == 0, 5).collect())) == whole


def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.array(df.embedding.tolist(), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -9)
    at = {v: i for i, v in enumerate(df.vec_id)}
    found = queries.op1_nearest_neighbours(spark, sf).toPandas()
    least = {q: np.sort(near[at[q]])[-5] for q in set(found.query_id)}
    assert np.mean([near[at[r.query_id], at[r.vec_id]] >= least[r.query_id] - 1e-9 for r in found.itertuples()]) >= 0.9
