"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first traversal.

The tree is fitted on a bounded sample (SAMPLE rows) by recursive spherical k-means; every row is indexed in the leaf that
greedy descent gives. A query walks the tree with a priority queue: the branch whose centre is nearest comes first,
inner nodes put their children into the queue, leaves are visited. How many leaves are visited is calibrated: the true
neighbours of CALIBRATION queries among all rows are found by brute force, and visits are widened leaf by leaf until the share of them that
lies in visited leaves reaches the target. Queries meet rows by leaf; leaves with many rows are split
into blocks, queries into parts, compared in slices, and of equal vectors only as many rows as can be among the nearest are kept, smallest ids first (the
others cannot be in a result, since ties go to smaller ids), so no task holds an unbounded group. Scores are exact
cosines in double precision.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors must be of one length. Null
ids take no part. A repeated id is a row of its own, and none of its rows is a candidate of its queries; its queries
count once. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.vectors import cosine, kmeans, matrix, sample, unit, usable

SAMPLE = 20_000
LEAF = 48
BRANCH = 8
CALIBRATION = 256
TARGET = 0.93
BLOCK_ROWS = 4096
#: Queries that meet a block of rows in one task, and those of them that are compared at a time.
QUERY_ROWS, SLICE = 32_768, 1024


class Tree:
    """Centres of nodes, children of inner nodes, leaves numbered from 0."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, branch: int = BRANCH):
        self.centres, self.children, self.leaf_of = [np.zeros(x.shape[1])], [[]], [-1]
        self.leaves = 0
        stack = [(0, x)]
        while stack:
            node, rows = stack.pop()
            centres, own = kmeans(rows, branch, seed=node) if len(rows) > leaf else (rows[:1], np.zeros(len(rows)))
            if len(centres) < 2:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            for k, c in enumerate(centres):
                self.children[node].append(len(self.centres))
                self.centres.append(c)
                self.children.append([])
                self.leaf_of.append(-1)
                stack.append((len(self.centres) - 1, rows[own == k]))
        self.centres = np.array(self.centres)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit row by greedy descent."""
        out = np.empty(len(x), dtype=np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            best = np.argmax(x[rows] @ self.centres[self.children[node]].T, axis=1)
            stack += [(c, rows[best == k]) for k, c in enumerate(self.children[node])]
        return out

    def visits(self, nearness: np.ndarray, counts: np.ndarray, leaves: int, rows: int) -> list[int]:
        """Leaves in best-bin-first order: at least so many, and until they hold so many rows. nearness: to all nodes."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < leaves or held < rows):
            _, node = heapq.heappop(queue)
            if (leaf := self.leaf_of[node]) >= 0:
                out.append(leaf)
                held += counts[leaf]
            for c in self.children[node]:
                heapq.heappush(queue, (-nearness[c], c))
        return out


def _best(q_ids, q, x_ids, x, k: int) -> tuple[list, list, list]:
    """Each query's k nearest rows of other ids: nearest first, ties to smaller ids."""
    out: tuple[list, list, list] = ([], [], [])
    scaled = unit(x).T
    for a in range(0, len(q), SLICE):
        near = unit(q[a : a + SLICE]) @ scaled
        near[q_ids[a : a + SLICE, None] == x_ids[None, :]] = -9
        for i, row in enumerate(near, a):
            least = np.partition(row, -k)[-k] if len(row) > k else -2
            few = np.flatnonzero(row >= max(least - 1e-9, -2))
            score = cosine(np.broadcast_to(q[i], (len(few), q.shape[1])), x[few])
            order = np.lexsort((x_ids[few], -score))[:k]
            out[0].extend([q_ids[i]] * len(order))
            out[1].extend(x_ids[few][order])
            out[2].extend(score[order])
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, target: float = TARGET, sample_rows: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: of the rows of vectors (vec_id, embedding) that is_query holds for, the k nearest."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    valid = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    fitted = sample(valid, sample_rows)
    result = "query_id long, vec_id long, score double"
    if not len(fitted):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(Tree(unit(fitted)))  # bounded by the sample
    leaves = shared.value.leaves

    def place(batches):
        for b in batches:
            leaf = shared.value.assign(unit(matrix(b.column(1)))) if b.num_rows else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["vec_id", "embedding", "is_query", "leaf"])

    placed = scratch.table(valid.mapInArrow(place, "vec_id long, embedding array<double>, is_query boolean, leaf int"))
    same = W.partitionBy("embedding").orderBy("vec_id")
    rows = placed.select("vec_id", "embedding", "leaf").distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")
    rows = scratch.table(rows)
    counts = np.zeros(leaves, dtype=np.int64)
    for r in rows.groupBy("leaf").count().collect():  # a row for each leaf
        counts[r["leaf"]] = r["count"]

    queries = placed.where("is_query").select("vec_id", "embedding").dropDuplicates(["vec_id"])
    wide = _calibrated(queries, rows, shared, counts, k, target)

    def walk(batches):
        for b in batches:
            tree, ids, where = shared.value, b.column(0).to_pylist(), []
            if ids:
                nearness = unit(matrix(b.column(1))) @ tree.centres.T
                where = [tree.visits(nearness[i], counts, wide, 4 * (k + 1)) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where, pa.list_(pa.int32()))], names=["vec_id", "embedding", "leaves"])

    parts = max(1, -(-queries.count() // QUERY_ROWS))  # a leaf's visitors are some of all queries
    blocks = F.split(F.lit(",".join(str(max(1, -(-int(c) // BLOCK_ROWS))) for c in counts)), ",").cast("array<int>")
    of = F.element_at(blocks, F.col("leaf") + 1)
    asked = queries.mapInArrow(walk, "vec_id long, embedding array<double>, leaves array<int>")
    asked = asked.select("vec_id", "embedding", F.explode("leaves").alias("leaf"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), of - 1)))
    held = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), of).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            got = ([], [], [])
        else:
            ids = [t.column("vec_id").to_numpy() for t in (left, right)]
            q, x = (matrix(t.column("embedding").combine_chunks()) for t in (left, right))
            got = _best(ids[0], q, ids[1], x, k)
        return pa.table([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = asked.groupBy("leaf", "block", "part").cogroup(held.groupBy("leaf", "block", "part")).applyInArrow(meet, result)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(queries: pd.DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """A bounded set of queries (vec_id, embedding) against all rows, in blocks: query_id, vec_id, score, leaf."""
    ids, q = queries["vec_id"].to_numpy(), np.array(queries["embedding"].tolist(), dtype=np.float64)

    def scan(batches):
        for b in batches:
            if b.num_rows:
                x_ids, leaf = b.column(0).to_numpy(), dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
                got = _best(ids, q, x_ids, matrix(b.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64()), pa.array([leaf[i] for i in got[1]], pa.int32())], names=["query_id", "vec_id", "score", "leaf"])

    near = rows.select("vec_id", "embedding", "leaf").mapInArrow(scan, "query_id long, vec_id long, score double, leaf int")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _calibrated(queries: DataFrame, rows: DataFrame, shared, counts: np.ndarray, k: int, target: float) -> int:
    """Leaves to visit: as few as hold so much of the true neighbours of some queries."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).toPandas()
    tree: Tree = shared.value
    if some.empty:
        return 1
    true = exact(some, rows, k).toPandas()  # CALIBRATION * k rows
    nearness = unit(np.array(some["embedding"].tolist())) @ tree.centres.T
    place = {}
    for i, q in enumerate(some["vec_id"]):
        place[q] = {leaf: n for n, leaf in enumerate(tree.visits(nearness[i], counts, tree.leaves, 0))}
    needed = np.array([place[q][leaf] for q, leaf in zip(true["query_id"], true["leaf"], strict=True)])
    return int(np.quantile(needed, target, method="higher")) + 1
