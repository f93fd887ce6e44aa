"""Operator 12 against plain k-means in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import kd_clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string, n int"


def plain(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in hashed[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
        if r < rounds:
            for c in range(len(centroids)):
                of = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                if of:
                    centroids[c] = [sum(col) // len(of) for col in zip(*of, strict=True)]
    distance = [far(v, centroids[o]) for (_, v), o in zip(kept, own, strict=True)]
    out = []
    for (i, _), o, d in zip(kept, own, distance, strict=True):
        digest = hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()
        out.append((i, o, d, sum(x for x, p in zip(distance, own, strict=True) if p == o), sum(distance), digest))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, kd_clusters.cluster(df, **kw).collect()), key=str)


@pytest.mark.parametrize(("dims", "spread", "k"), [(2, 3.0, 5), (6, 0.3, 16), (64, 1.0, 16)])
def test_equals_plain(spark, monkeypatch, dims, spread, k):
    monkeypatch.setattr(kd_clusters, "BLOCK", 100)
    monkeypatch.setattr(kd_clusters, "LEAF", 4)
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(5, dims))[rng.integers(0, 5, 300)] * spread + rng.normal(size=(300, dims)) * 0.2
    x[200:260] = np.round(x[200:260])  # ties, and one vector many times
    x[260:] = x[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(7, x[9].tolist()), (7, x[9].tolist()), (None, x[8].tolist()), (900, None), (901, []), (902, [0.0] * (dims + 1)), (903, [None] * dims), (904, [float("nan")] * dims), (905, [float("-inf")] * dims)]
    assert run(spark, rows, k=k, dims=dims) == plain(rows, k, 3, dims)


def test_large_components(spark):
    """Beyond what doubles hold exactly, in whole numbers; beyond what longs hold, an error."""
    rng = np.random.default_rng(5)
    rows = [(int(i), (v * 300_000).tolist()) for i, v in enumerate(rng.normal(size=(80, 4)))]
    assert run(spark, rows, k=6, dims=4) == plain(rows, 6, 3, 4)
    with pytest.raises(Exception, match="a component beyond"):
        run(spark, [(1, [1e9] * 4), (2, [0.0] * 4)], k=2, dims=4)


def test_few_and_none(spark):
    assert run(spark, [], dims=2) == []
    assert run(spark, [(1, None)], dims=2) == []
    rows = [(3, [1.0, 2.0]), (4, [1.0, 2.0])]
    assert run(spark, rows, dims=2) == plain(rows, 16, 3, 2)
    assert run(spark, [(None, [1.0, 2.0])], dims=2) == []


def test_whole_nodes_are_assigned():
    """Tight, distant groups: nodes go whole; only leaves on both sides of a gap, which halves do not fall into, are compared."""
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [5000, 0], [0, 5000], [5000, 5000]])
    x = (centres[rng.integers(0, 4, 4000)] + rng.integers(-50, 50, (4000, 2))).astype(np.int64)
    rows = kd_clusters.build(np.arange(len(x)), x)
    as_array = lambda n, kind: np.array(rows[n], dtype=kind)
    tree = kd_clusters.Tree.__new__(kd_clusters.Tree)
    tree.points, tree.lo, tree.hi, tree.sums = (as_array(n, np.int64).reshape(-1, 2) for n in ("points", "lo", "hi", "sums"))
    tree.first, tree.last, tree.child = (as_array(n, np.int64) for n in ("first", "last", "child"))
    walk = kd_clusters.Filter(centres.astype(np.int64))
    by_row = sum(len(which) for kind, which, _ in walk.walk(tree) if kind == "rows")
    assert by_row < 400
    counts, sums = walk.totals(tree)
    own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert counts.tolist() == np.bincount(own, minlength=4).tolist()
    assert all((sums[c] == x[own == c].sum(axis=0)).all() for c in range(4))
