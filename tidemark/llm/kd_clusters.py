"""Centroid clustering of integer vectors by the filtering algorithm on kd-trees (Kanungo et al., 2002).

Every task deals its rows to kd-trees of at most BLOCK rows, once; they are kept as rows of a table in the shared folder.
Nodes hold counts, integer sums and boxes. A round takes every tree through the centroids: a centroid that is strictly
farther than another one from all of a node's box leaves that node's candidates, a node with one candidate is counted
whole, and a leaf with several is resolved row by row. Only k sums a task meet in a shuffle, so a round costs one scan
of the trees; k centroids are all that the driver holds.

All numbers are integers, and doubles that carry them stay below 2^53, so no result depends on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, small_batches

#: Rows of a tree, and of a leaf (rows that are all equal make one leaf of any size).
BLOCK, LEAF = 4096, 32
#: Largest component: with it, squared distances and box bounds of 64 components still are longs.
LARGEST = 1 << 26
#: Up to this component, products and their sums are exact in doubles.
EXACT = 1 << 21

TREES = "ids array<long>, points array<long>, first array<int>, last array<int>, child array<int>, lo array<long>, hi array<long>, sums array<long>"


def whole(vector: Column, dims: int) -> Column:
    """Exactly dims components, none null or non-finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False))), F.lit(False))


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, x as a double."""
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dims)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST // scale}: squared distances would not fit a long")
    return flat.astype(np.int64)


def build(ids: np.ndarray, x: np.ndarray) -> dict[str, list]:
    """One tree: rows in the tree's order, and for each node its rows, left child (-1: leaf; the right one follows), box and sums."""
    order, nodes = np.arange(len(x)), [(0, len(x))]
    child = [-1]
    for n, (a, b) in enumerate(nodes):  # grows while it is walked
        own = x[order[a:b]]
        width = own.max(axis=0) - own.min(axis=0)
        d = int(np.argmax(width))
        if b - a <= LEAF or not width[d]:
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, d], middle)]
        child[n] = len(nodes)
        nodes += [(a, a + middle), (a + middle, b)]
        child += [-1, -1]
    x = x[order]
    parts = [x[a:b] for a, b in nodes]
    flat = lambda f: np.concatenate([f(p) for p in parts]).tolist()
    return {
        "ids": [None if i is None else int(i) for i in ids[order]], "points": x.ravel().tolist(),
        "first": [a for a, _ in nodes], "last": [b for _, b in nodes], "child": child,
        "lo": flat(lambda p: p.min(axis=0)), "hi": flat(lambda p: p.max(axis=0)), "sums": flat(lambda p: p.sum(axis=0)),
    }


class Tree:
    def __init__(self, row: pa.StructScalar | dict, dims: int):
        array = lambda n, t: np.asarray(row[n].values.to_numpy(zero_copy_only=False), dtype=t)
        self.ids = row["ids"].values
        self.points, self.lo, self.hi, self.sums = (array(n, np.int64).reshape(-1, dims) for n in ("points", "lo", "hi", "sums"))
        self.first, self.last, self.child = (array(n, np.int64) for n in ("first", "last", "child"))


class Filter:
    """Walks trees with fixed centroids."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.number = np.arange(len(centroids))

    def _numbers(self, largest: int) -> None:
        kind = np.float64 if max(largest, int(np.abs(self.c).max())) <= EXACT else np.int64
        self.kind, self.z = kind, self.c.astype(kind)
        self.norm = (self.z * self.z).sum(axis=1)

    def nearest(self, x: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
        """The nearest centroid of each row (among the alive ones), ties to the smaller number."""
        far = self.norm - 2 * (x.astype(self.kind) @ self.z.T)
        if alive is not None:
            far = np.where(alive, far, np.inf if self.kind is np.float64 else np.iinfo(np.int64).max)
        return far.argmin(axis=1)

    def walk(self, tree: Tree) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """('whole', nodes, centroids) of nodes with one candidate, then ('rows', rows, centroids) of leaves with several."""
        self._numbers(int(max(np.abs(tree.lo).max(), np.abs(tree.hi).max())))
        at, alive = np.zeros(1, dtype=np.int64), np.ones((1, len(self.c)), dtype=bool)
        while len(at):
            lo, hi = tree.lo[at].astype(self.kind), tree.hi[at].astype(self.kind)
            # Of the candidates, the one nearest to the middle of the box (all doubled, to stay whole).
            far = 2 * self.norm - 2 * ((lo + hi) @ self.z.T)
            best = np.where(alive, far, far.max() + 1).argmin(axis=1)
            for star in np.unique(best):
                rows = np.flatnonzero(best == star)
                step = self.z - self.z[star]
                # The corner of the box that is best for each other centroid, against the star: farther even there?
                reach = hi[rows] @ np.maximum(step, 0).T + lo[rows] @ np.minimum(step, 0).T
                alive[rows] &= ~(self.norm - self.norm[star] - 2 * reach > 0)
            one = alive.sum(axis=1) == 1
            if one.any():
                yield "whole", at[one], alive[one].argmax(axis=1)
            rest, left = at[~one], alive[~one]
            leaf = tree.child[rest] < 0
            for n, own in zip(rest[leaf], left[leaf], strict=True):
                rows = np.arange(tree.first[n], tree.last[n])
                yield "rows", rows, self.nearest(tree.points[rows], own[None])
            inner = tree.child[rest[~leaf]]
            at, alive = np.concatenate([inner, inner + 1]), np.tile(left[~leaf], (2, 1))

    def totals(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        counts, sums = np.zeros(len(self.c), dtype=np.int64), np.zeros_like(self.c)
        for kind, which, to in self.walk(tree):
            n, s = (tree.last[which] - tree.first[which], tree.sums[which]) if kind == "whole" else (np.ones(len(which), dtype=np.int64), tree.points[which])
            np.add.at(counts, to, n)
            np.add.at(sums, to, s)
        return counts, sums

    def assign(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        own = np.empty(len(tree.points), dtype=np.int64)
        for kind, which, to in self.walk(tree):
            if kind == "rows":
                own[which] = to
            else:
                for n, z in zip(which, to, strict=True):
                    own[tree.first[n] : tree.last[n]] = z
        gap = tree.points - self.c[own]
        return own, (gap * gap).sum(axis=1)


def _trees(batch: pa.RecordBatch, dims: int) -> Iterator[Tree]:
    for i in range(batch.num_rows):
        yield Tree({n: batch.column(n)[i] for n in batch.schema.names}, dims)


def grow(vectors: DataFrame, scratch: Scratch, dims: int, scale: int) -> DataFrame:
    """The trees of vectors (vec_id, embedding), a row each."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.list_(pa.int64() if t == "array<long>" else pa.int32())) for n, t in (c.strip().split(" ") for c in TREES.split(","))])
        ids, points, held = [], [], 0

        def out() -> pa.RecordBatch:
            tree = build(np.concatenate(ids), np.concatenate(points))
            ids.clear()
            points.clear()
            return pa.RecordBatch.from_pylist([tree], schema=schema)

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                if held + part.num_rows > BLOCK:
                    yield out()
                    held = 0
                ids.append(np.array(part.column(0).to_pylist(), dtype=object))
                points.append(integers(part.column(1), dims, scale))
                held += part.num_rows
        if held:
            yield out()

    return scratch.table(vectors.select("vec_id", "embedding").mapInArrow(run, TREES))


def _sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and sums of every non-empty cluster."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, counts, sums = Filter(centroids), np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        for batch in batches:
            for tree in _trees(batch, dims):
                n, s = walk.totals(tree)
                counts, sums = counts + n, sums + s
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64()), "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})

    each = trees.mapInArrow(run, "cluster long, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = each.select("cluster", F.posexplode(F.concat(F.array("n"), "sums"))).groupBy("cluster", "pos").agg(exact("col").alias("total")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:  # k * (dims + 1) numbers at most
        out.setdefault(r["cluster"], {})[r["pos"]] = int(r["total"])
    return {c: (v[0], [v[d + 1] for d in range(dims)]) for c, v in out.items()}


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Centroids start as the k vectors with the smallest SHA-256 of `seed:vec_id`. Vectors that are null, of another length or
    hold null or non-finite components take no part and get no row. Rows of one id are rows of their own; of such rows the
    start is the one with the smallest vector, and the same vector may start two centroids (the second then stays empty). A row
    without an id is clustered but starts no centroid. With fewer than k vectors there are as many centroids as vectors; an
    empty table gives no rows; other columns are ignored. A component beyond 2^26 / scale raises an error."""
    spark = embeddings.sparkSession
    schema = "vec_id long, cluster int, distance long"
    scratch = Scratch(spark)
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(whole(F.col("embedding"), dims))
    hashed = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    firsts = hashed.orderBy("h", "embedding").limit(k).select("embedding").toArrow()
    centroids = integers(firsts.column(0).combine_chunks(), dims, scale) if firsts.num_rows else np.zeros((0, dims), dtype=np.int64)
    if not len(centroids):
        rows = spark.createDataFrame([], schema)
        return rows.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    trees = grow(vectors, scratch, dims, scale)
    for _ in range(rounds):
        got = _sums(trees, centroids)
        centroids = np.array([[s // got[c][0] for s in got[c][1]] if c in got else row.tolist() for c, row in enumerate(centroids)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Filter(centroids)
        for batch in batches:
            for tree in _trees(batch, dims):
                own, far = walk.assign(tree)
                yield pa.RecordBatch.from_arrays([tree.ids.cast(pa.int64()), pa.array(own, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    rows = scratch.table(trees.mapInArrow(run, schema))
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    facts = [(c, s, sum(inertia.values()), digest(centroids[c])) for c, s in inertia.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
