"""Embedding near-dedup on robust-pruned flat graphs.

Equal vectors of a label are one node with a size. Nodes go to cluster shards of their label: their own, that of the
nearest centre, and every other one that may hold a node similar enough to them as its own. A unit vector within chord d
of u can lie beyond the bisector of two centres only if u is within d of it; as a difference of that length seldom points
straight at the bisector, shards overlap by OVERLAP deviations of its projection (d / sqrt(dimensions)), or by the whole d
where that is less. The links of AUDITED rows, found by brute force among all rows, must all be found: if one is missed,
the overlap is widened by a quarter, up to d, where no link can be missed, and the shards are dealt again. Each shard builds a flat graph: near neighbours and some far ones, pruned robustly (an edge goes if a kept
neighbour is clearly nearer to its end), with all reverse edges, so that no node is without a way to it. The adjacency lists of a node from all its shards are
united. Then every node is searched for in its own shard over the united lists, from the medoid and from itself: the
best unexpanded nodes of the beam are expanded, and all nodes within the radius, until none is left. Some nodes of each
shard are audited against brute force; if a link was missed, the beam is made four times as wide and the shard searched again. Links are
verified on the original vectors in double precision; inside a shard they are counted and joined to local components,
never listed, and the components of all shards are joined at the end.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label or an id, link with
nothing: n_links 0, their own component, kept. Repeated ids are one node if their vectors are equal, else nodes of their own,
each of them another vector to those that it links with; a component is named by the least id among its nodes. An empty table gives
an empty result. A shard is one task's work; near copies that all lie within the radius of each other stay in one
shard, however many they are, unless they are equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, connected_components
from tidemark.llm.vectors import cosine, kmeans, matrix, sample, unit, usable

SAMPLE = 20_000
#: Rows of one label in a shard before overlap. Graph work grows with the copies dealt, so shards are as large as a task holds well.
SHARD_ROWS = 2048
DEGREE = 16
NEAREST = 48
FAR = 8
ALPHA = 1.2
BEAM = 16
AUDIT = 24
#: Rows audited against all rows of their label, and by how many deviations shards overlap at first.
AUDITED = 128
OVERLAP = 5.5


def build(x: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Robust-pruned adjacency lists of unit rows."""
    n = len(x)
    rng = np.random.default_rng(n)
    near = min(NEAREST, n - 1)
    kept: list[np.ndarray] = []
    for a in range(0, n, 512):
        block = np.arange(a, min(a + 512, n))
        sims = x[block] @ x.T
        sims[np.arange(len(block)), block] = -9
        cand = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near else np.empty((len(block), 0), dtype=int)
        cand = np.concatenate([cand, rng.integers(0, n, (len(block), FAR))], axis=1)
        dist = 1 - np.take_along_axis(sims, cand, axis=1)
        dist[cand == block[:, None]] = np.inf
        ends = x[cand]
        gaps = 1 - ends @ ends.transpose(0, 2, 1)
        chosen = np.full((len(block), degree), -1)
        for d in range(degree):
            best = np.argmin(dist, axis=1)
            at = np.arange(len(block))
            live = np.isfinite(dist[at, best])
            if not live.any():
                break
            pick = cand[at, best]
            chosen[live, d] = pick[live]
            gone = (ALPHA * gaps[at, best] <= dist) | (cand == pick[:, None])
            dist[gone & live[:, None]] = np.inf
        kept += [row[row >= 0] for row in chosen]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(kept):
        for j in row.tolist():
            back[j].append(i)
    return [np.unique(np.concatenate([row, np.array(b, dtype=np.int64)])).astype(np.int64) for row, b in zip(kept, back, strict=True)]


def compressed(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists as where each begins and their ends, one after another."""
    return np.cumsum([0, *map(len, lists)]), np.array([j for row in lists for j in row], dtype=np.int64)


def within(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], queries: np.ndarray, entry: int, radius: float, beam: int) -> np.ndarray:
    """Similarity of each query to the rows that a range-expanding greedy search from entry finds; -9 elsewhere.

    A round expands what is unexpanded among the best `beam` found so far and all within the radius.
    """
    starts, ends = graph
    n, at = len(x), np.arange(len(queries))
    sims = np.full((len(queries), n), -9.0)
    open_ = np.zeros((len(queries), n), dtype=bool)
    for start in (np.full(len(queries), entry), queries):
        sims[at, start] = np.einsum("qd,qd->q", x[queries], x[start])
        open_[at, start] = True
    live, k = at, min(beam, n)
    while len(live):
        now = sims[live]
        floor = np.minimum(np.partition(now, n - k, axis=1)[:, n - k], radius - 1e-6)
        ready = open_[live] & (now >= floor[:, None])
        rows, nodes = np.nonzero(ready)
        rows = live[rows]
        live = live[ready.any(axis=1)]
        open_[rows, nodes] = False
        fresh = np.zeros((len(queries), n), dtype=bool)
        for a in range(0, len(rows), 20_000):
            r, t = rows[a : a + 20_000], nodes[a : a + 20_000]
            many = starts[t + 1] - starts[t]
            to = np.arange(many.sum()) + np.repeat(starts[t] - (np.cumsum(many) - many), many)
            fresh[np.repeat(r, many), ends[to]] = True
        rows, nodes = np.nonzero(fresh & (sims == -9))
        for a in range(0, len(rows), 200_000):
            r, t = rows[a : a + 200_000], nodes[a : a + 200_000]
            sims[r, t] = np.einsum("qd,qd->q", x[queries[r]], x[t])
        open_[rows, nodes] = True
    return sims


def _linked(x: np.ndarray, raw: np.ndarray, graph: tuple[np.ndarray, np.ndarray], own: np.ndarray, entry: int, radius: float, beam: int):
    """For each own row, the rows that are verified to be similar enough, itself left out."""
    for a in range(0, len(own), 256):
        block = own[a : a + 256]
        sims = within(x, graph, block, entry, radius, beam)
        i, j = np.nonzero(sims >= radius - 1e-6)
        apart = block[i] != j
        i, j = i[apart], j[apart]
        true = np.concatenate([cosine(raw[block[i[b : b + 100_000]]], raw[j[b : b + 100_000]]) >= radius for b in range(0, len(i), 100_000)] or [np.empty(0, dtype=bool)])
        i, j = i[true], j[true]
        ends = np.searchsorted(i, np.arange(len(block) + 1))
        for k, row in enumerate(block):
            yield row, j[ends[k] : ends[k + 1]]


def search_shard(ids: np.ndarray, raw: np.ndarray, sizes: np.ndarray, own: np.ndarray, lists: list, radius: float) -> pd.DataFrame:
    """node, links, root: of the shard's own rows, links counted by size; of all rows, the smallest id joined to them here."""
    n = len(ids)
    x = unit(raw)
    where = {v: i for i, v in enumerate(ids.tolist())}
    near = [[where[v] for v in row if v in where] for row in lists]
    graph = compressed(near)
    mean = x.mean(axis=0)
    entry = int(np.argmax(x @ mean))
    mine = np.flatnonzero(own)
    probe = mine[:: max(1, len(mine) // AUDIT)]
    truth = {int(i): set(np.flatnonzero(cosine(np.broadcast_to(raw[i], raw.shape), raw) >= radius).tolist()) - {int(i)} for i in probe}
    beam = BEAM
    while True:
        links, group = np.zeros(n, dtype=np.int64), np.arange(n)
        missed = False
        for i, found in _linked(x, raw, graph, mine, entry, radius, beam):
            links[i] = sizes[found].sum()
            missed |= int(i) in truth and truth[int(i)] != set(found.tolist())
            roots = np.unique(np.append(group[found], group[i]))
            if len(roots) > 1:
                group[np.isin(group, roots)] = roots[0]
        if not missed or beam >= n:
            break
        beam *= 4
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    return pd.DataFrame({"node": ids, "links": np.where(own, links, -1), "root": least[group]})


def _audit(nodes: DataFrame, radius: float) -> DataFrame:
    """node, links of AUDITED nodes, counted over all nodes of their label."""
    spark = nodes.sparkSession
    some = nodes.orderBy(F.xxhash64("least"), "least", "embedding").limit(AUDITED).toPandas()
    asked, label = np.array(some["embedding"].tolist()), some["label"].to_numpy()
    of, names = some["node"].to_numpy(), unit(asked)

    def count(batches):
        total = np.zeros(len(of), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                raw, own = matrix(b.column(1)), np.array(b.column(2).to_pylist())
                near = (names @ unit(raw).T >= radius - 1e-6) & (label[:, None] == own[None, :]) & (of[:, None] != b.column(0).to_numpy()[None, :])
                i, j = np.nonzero(near)
                true = cosine(asked[i], raw[j]) >= radius if len(i) else np.empty(0, dtype=bool)
                total += np.bincount(i[true], weights=b.column(3).to_numpy()[j[true]], minlength=len(of)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(total)], names=["node", "links"])

    counted = nodes.select("node", "embedding", "label", "size").mapInArrow(count, "node long, links long")
    rows = [(r.node, r.links) for r in counted.groupBy("node").agg(F.sum("links").alias("links")).collect()]  # AUDITED rows
    return spark.createDataFrame(rows, "node long, links long")


def _searched(nodes: DataFrame, shared, reach: float, radius: float, scratch: Scratch) -> DataFrame:
    """node, links (-1 out of its own shard), root: each shard's search, shards overlapping by reach."""

    def deal(batches):
        centres = shared.value
        apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) + 1e-7
        for b in batches:
            if not b.num_rows:
                continue
            near = unit(matrix(b.column(1))) @ centres.T
            own = np.argmax(near, axis=1)
            row, shard = np.nonzero(near[np.arange(len(own)), own][:, None] - near <= reach * apart[own])
            out = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shard.astype(np.int32)), pa.array(own[row] == shard)], names=["node", "embedding", "label", "size", "shard", "own"])

    kind = nodes.schema["label"].dataType.simpleString()
    dealt = nodes.select("node", "embedding", "label", "size").mapInArrow(deal, f"node long, embedding array<double>, label {kind}, size long, shard int, own boolean")
    dealt = scratch.table(dealt)

    def graph(rows: pa.Table) -> pa.Table:
        ids = rows.column("node").to_numpy()
        lists = build(unit(matrix(rows.column("embedding").combine_chunks()))) if len(ids) > 1 else [np.empty(0, dtype=np.int64)]
        return pa.table([rows.column("node"), pa.array([ids[x] for x in lists], pa.list_(pa.int64()))], names=["node", "near"])

    lists = dealt.groupBy("label", "shard").applyInArrow(graph, "node long, near array<long>")
    united = scratch.table(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # one list a shard

    def find(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        got = search_shard(
            rows.column("node").to_numpy(), matrix(rows.column("embedding").combine_chunks()), rows.column("size").to_numpy(),
            rows.column("own").to_numpy(), rows.column("near").to_pylist(), radius,
        )
        return pa.Table.from_pandas(got, preserve_index=False)

    found = dealt.join(united, "node").groupBy("label", "shard").applyInArrow(find, "node long, links long, root long")
    found = scratch.table(found)
    scratch.drop(dealt)
    scratch.drop(united)
    return found


def near_duplicates(vectors: DataFrame, radius: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    valid = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    classes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.countDistinct("vec_id").alias("size"))
    nodes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()))  # unequal vectors may share their least id
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0]
    if largest is None:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    fitted = unit(sample(nodes.withColumnRenamed("least", "vec_id"), SAMPLE))
    shards = max(1, min(-(-largest // SHARD_ROWS), len(fitted) // 32))
    shared = spark.sparkContext.broadcast(kmeans(fitted, shards)[0])  # bounded by the sample
    dims = fitted.shape[1]
    chord = float(np.sqrt(2 - 2 * radius)) + 1e-6
    truth = _audit(nodes, radius)
    overlap = min(1.0, OVERLAP / np.sqrt(dims))
    while True:
        found = _searched(nodes, shared, overlap * chord, radius, scratch)
        got = {r.node: r.links for r in found.join(F.broadcast(truth.select("node")), "node").groupBy("node").agg(F.max("links").alias("links")).collect()}
        if overlap >= 1 or all(got[r.node] == r.links for r in truth.collect()):
            break
        scratch.drop(found)
        overlap = min(1.0, 1.25 * overlap)
    component = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    per_node = found.groupBy("node").agg(F.max("links").alias("links")).join(component, "node", "left")
    per_class = nodes.join(per_node, "node").select("label", "embedding", "least", (F.col("links") + F.col("size") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    per_class = scratch.table(per_class)
    least = per_class.groupBy("component").agg(F.min("least").alias("first"))
    per_class = per_class.join(least, "component").select("label", "embedding", "links", F.col("first").alias("component"))
    ok = F.col("label").isNotNull() & usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    keyed = named.withColumn("label", F.when(ok, F.col("label"))).withColumn("embedding", F.when(ok, F.col("embedding")))
    own = F.coalesce("component", "vec_id")
    return keyed.join(per_class, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id").eqNullSafe(own)).alias("kept")
    )
