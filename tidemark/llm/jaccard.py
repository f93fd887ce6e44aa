"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds its distinct word n-grams (hashed to 64 bits). All sets are put in one global order, rarest
tokens first; how common a token is comes from a count sketch of fixed size over all documents. Tokens that share a counter
add noise of about the square root of the median counter, so what is told apart is a token that stands in more than twice
that many documents: a bound that grows with the root of the corpus. The order needs to be the same for all, not exact. If two sets are similar enough, their prefixes of
length n - c + l (c: the least overlap that a set of size n allows, l: a level) share at least l tokens. Each document
takes the level that makes its estimated cost least: the postings to scan plus the candidates to verify, which are at
most the postings divided by l. A pair is a candidate if its prefixes share at least as many tokens as the lower of the
two levels, and is then verified on the whole sets. Prefix tokens up to a shared one that no other prefix has are not in the
other document of a pair that shares it: they and its place bound the overlap from above and the union from
below. Pairs that cannot reach the similarity are dropped in the join, before they are counted.

Documents with the same set are one node. Candidates are looked for in two steps, so that a group of thousands of near
copies does not turn into all its pairs: first each token joins its documents with a central one only; what these links
connect is one component. Then only tokens that still stand in more than one component give pairs, and only pairs
between components that have not been verified yet, met by steps of size, and of the tokens that a pair shares only from the one
on that can be the last of those it must share. No join or count is dealt by an explicit
partitioning, so the runtime splits a token that millions of documents hold. No candidate between different components is left out, so the
components are exact; links inside a component are not listed.

Null text and text without words have an empty set and link with nothing. With fewer than n words the whole sequence is
the one n-gram. Nodes are sets, not ids: rows of one id with unequal texts are nodes of their own, and every row gets the
component of its own text, named by the smallest id in it. Rows with a null id take part under no name: they get
their own set size and a null component. Texts are read whole, however long; a document's prefix is one row of postings
a token. Other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BROADCAST_ROWS, Scratch, connected_components, is_small, map_text, maybe_broadcast, slices, small_batches, use_table

#: Counters of the sketch (4 bytes each), and the blocks in which it is added up.
SKETCH = 1 << 18
BLOCKS = 64
MAX_LEVEL = 8
#: Cost of verifying one candidate, in postings scanned.
VERIFY = 20.0
KNOWN_WORDS = 250_000
#: Words of 64 bits in a set's signature.
SIGNATURE = 32


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; A-Z lower-cased, words split at space, tab and line ends."""
    use_table("hashes", _hashes.clear)
    words = [t.lower().split() if t else [] for t in texts]
    sizes = [len(w) for w in words]
    flat = np.fromiter((h for w in words for h in map(_hashes.__getitem__, w)), dtype=np.uint64, count=sum(sizes))
    rolled = np.zeros(max(0, len(flat) - n + 1), dtype=np.uint64)
    for i in range(n):
        rolled = _mixed(rolled + flat[i : len(flat) - n + 1 + i] * np.uint64(2 * i + 1))
    out, at = [], 0
    for size in sizes:
        if size >= n:
            out.append(np.unique(rolled[at : at + size - n + 1]))
        elif size:
            short = size
            for h in flat[at : at + size].tolist():
                short = (short * 0x9E3779B97F4A7C15 + h) % 2**64
            out.append(_mixed(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += size
    return out


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How often tokens with the same low bits stand in all documents: SKETCH counters, whatever the corpus."""
    per = SKETCH // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                sets = shingle_sets(part.column(0).to_pylist(), n)
                tokens = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
                total += np.bincount((tokens & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        rows = [np.minimum(total[i * per : (i + 1) * per], 2**32 - 1).astype("<u4").tobytes() for i in range(BLOCKS)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array([part % 256] * BLOCKS, pa.int32()), pa.array(rows, pa.binary())],
            names=["block", "salt", "counts"],
        )

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(per, dtype=np.int64)
        for x in rows["counts"]:
            total += np.frombuffer(x, dtype="<u4")
        total = np.minimum(total, 2**32 - 1).astype("<u4")
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "salt": [0], "counts": [total.tobytes()]})

    schema = "block int, salt int, counts binary"
    small_batches(docs.sparkSession)
    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, schema)
    added = parts.groupBy("block", "salt").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    out = np.zeros(SKETCH, dtype=np.int64)
    for r in added.collect():  # BLOCKS rows
        out[r.block * per : (r.block + 1) * per] = np.frombuffer(r.counts, dtype="<u4")
    return out


def prefix(tokens: np.ndarray, counts: np.ndarray, usual: float, percent: int) -> tuple[int, np.ndarray]:
    """A document's level and its prefix at that level. usual: the median counter, which common tokens do not move."""
    n = len(tokens)
    c = (percent * n + 99) // 100
    often = counts[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
    excess = (often - usual) / math.sqrt(max(usual, 1.0))
    rank = np.floor(np.log2(np.maximum(excess, 1.0))).astype(np.uint64)
    order = np.argsort((np.minimum(rank, np.uint64(63)) << np.uint64(58)) | (tokens >> np.uint64(6)), kind="stable")
    base = n - c
    most = min(MAX_LEVEL, c)
    scan = np.cumsum(np.maximum(often[order[: base + most]] - usual, 0.0) + 1.0)[base:]
    levels = np.arange(1, most + 1)
    level = int(np.argmin(scan + VERIFY * scan / levels)) + 1 if scan[0] > 4 * (base + 1) else 1
    return level, tokens[order[: base + level]]


def _features(docs: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key, level, prefix: one row per row of docs."""
    usual = float(np.median(counts))
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # SKETCH numbers

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1).to_pylist(), n)
        keys = _keyed(sets)
        picked = [prefix(s, shared.value, usual, percent) if len(s) else (0, s) for s in sets]
        ends = np.cumsum([0] + [len(p) for _, p in picked]).astype(np.int32)
        flat = np.concatenate([*[p for _, p in picked], np.empty(0, dtype=np.uint64)]).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([x for x, _ in picked], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "n_shingles", "set_key", "level", "prefix"],
        )

    return map_text(
        docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")], step,
        "doc_id long, n_shingles long, set_key binary, level int, prefix array<long>",
    )


def _keyed(sets: list[np.ndarray]) -> list[bytes | None]:
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]


def with_set_key(docs: DataFrame, n: int) -> DataFrame:
    """docs with set_key, which tells sets apart; null for an empty set."""
    at = docs.columns.index("text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else t.encode() for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(_keyed(shingle_sets(texts, n)), pa.binary())], names=[*batch.schema.names, "set_key"])

    return map_text(docs, [F.col(f"`{c}`") for c in docs.columns], step, T.StructType([*docs.schema.fields, T.StructField("set_key", T.BinaryType())]), text=at)


def signature(tokens: np.ndarray) -> np.ndarray:
    """SIGNATURE words of bits; each token sets one. A bit that only one of two sets has stands for a token at least that the
    other set lacks."""
    bits = np.zeros(64 * SIGNATURE, dtype=np.uint8)
    bits[(tokens >> np.uint64(32)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).view(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """set_key, size, bits, tokens of the rows of docs whose ids wanted (doc_id) names."""
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if is_small(ids) else ids

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1).to_pylist(), n)
        listed = lambda parts: pa.ListArray.from_arrays(
            pa.array(np.cumsum([0] + [len(x) for x in parts]).astype(np.int32)), pa.array(np.concatenate([*parts, np.empty(0, dtype=np.int64)]))
        )
        sizes = pa.array([len(s) for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(_keyed(sets), pa.binary()), sizes, listed([signature(s) for s in sets]), listed([s.view(np.int64) for s in sets])], names=["set_key", "size", "bits", "tokens"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_text(named.join(ids, "doc_id", "left_semi"), ["doc_id", "text"], step, "set_key binary, size long, bits array<long>, tokens array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are similar enough. Signatures meet first; whole sets only of pairs that they leave."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = scratch.table(nodes.select("node", "doc_id", "set_key").join(named, "node"))
    sets = scratch.table(_sets(docs, ids, n))
    if not sets.groupBy("set_key").count().where("count > 1").isEmpty():  # rows of one id and set
        once = scratch.table(sets.groupBy("set_key").agg(*(F.first(c).alias(c) for c in ("size", "bits", "tokens"))))
        scratch.drop(sets)
        sets = once
    keyed = pairs
    for x in "ab":
        keyed = keyed.join(ids.select(F.col("node").alias(x), F.col("set_key").alias(f"k{x}")), x)
    similar = lambda both: f"100 * {both} >= {percent} * (size_a + size_b - {both})"

    def met(those: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
        for x in "ba":
            those = those.join(sets.select(F.col("set_key").alias(f"k{x}"), *(F.col(c).alias(f"{c}_{x}") for c in columns)), f"k{x}")
        return those

    lacks = "aggregate(zip_with(bits_{0}, bits_{1}, (x, y) -> bit_count(x & ~y)), 0, (s, c) -> s + c)"
    most = f"least(size_a - {lacks.format('a', 'b')}, size_b - {lacks.format('b', 'a')})"
    near = scratch.table(met(keyed, sets, "size", "bits").selectExpr("a", "b", "ka", "kb", "size_a", "size_b", f"{most} as most").where(similar("most")).drop("most"))
    left = near.select(F.explode(F.array("ka", "kb")).alias("set_key")).distinct()
    whole = sets.join(maybe_broadcast(left, BROADCAST_ROWS // 4), "set_key", "left_semi")
    both = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    out = scratch.table(met(near, whole, "tokens").select("a", "b", "size_a", "size_b", both.alias("common")).where(similar("common")).select("a", "b"))
    for t in (sets, ids, near):
        scratch.drop(t)
    return out


def _may_link(x: str, y: str, percent: int) -> str:
    """Whether two documents that share the token of this row can be similar enough.

    Both prefixes reach this token, so whatever both documents have up to it (in the global order) stands in both
    prefixes: it is among the `at` tokens of each that another prefix has too. Of tokens behind this one, `pos` being its
    place in the prefix, each has n - pos. Nothing is known of a token further on that no other prefix has: it may stand
    in the other document behind the end of its prefix. Only the number of prefix tokens shared is bounded by those (u).
    """
    left = f"{{0}}.n - ({percent} * {{0}}.n + 99) div 100 + {{0}}.level - {{0}}.u - {{0}}.at"
    both = f"(least({x}.at, {y}.at) + least({x}.n - {x}.pos, {y}.n - {y}.pos))"
    return (
        f"100 * {both} >= {percent} * ({x}.n + {y}.n - {both})"
        f" and least({x}.at, {y}.at) + least({left.format(x)}, {left.format(y)}) >= {_need(x, y, percent)}"
    )


def _need(x: str, y: str, percent: int) -> str:
    """How many prefix tokens documents x and y must share.

    At least the lower of their levels. And of the document whose prefix ends first in the global order, every token
    missing among the shared ones is missing in the other document: the overlap is at most the shared ones and
    what stands behind the prefix (n - prefix length, that is c - level), and must reach its share of both sizes.
    """
    behind = f"({percent} * {{0}}.n + 99) div 100 - {{0}}.level"
    overlap = f"({percent} * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent}"
    return f"greatest(least({x}.level, {y}.level), {overlap} - greatest({behind.format(x)}, {behind.format(y)}))"


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of met (a row for each token that documents x and y share) with as many as must be shared."""
    return (
        met.where(_may_link("x", "y", percent))
        .groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.expr(_need("x", "y", percent)).alias("need"))
        .agg(F.count("*").alias("shared"))
        .where("shared >= need")
        .select("a", "b")
    )


def _late_candidates(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of met with a shared token that can be the last of as many as must be shared: in both documents, as many
    tokens that another prefix has stand up to it. A pair that shares enough has such a token, and most others have none."""
    late = f"least(x.at, y.at) >= {_need('x', 'y', percent)}"
    return met.where(f"{late} and {_may_link('x', 'y', percent)}").select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def _last_of_alike(shared: DataFrame) -> DataFrame:
    """tok: of tokens that stand in the same documents, the last one in the global order. A pair shares all of them or none, and if
    any can be the last that it must share, so can that one. Documents are told apart by a count and two sums of hashes."""
    each = F.xxhash64("y.doc")
    alike = shared.groupBy("tok").agg(
        F.count("*").alias("n"), F.bit_xor(each).alias("p"), F.sum(F.shiftright(each, 31)).alias("q"), F.min(F.struct("y.doc", "y.at")).alias("least")
    )
    return alike.groupBy("n", "p", "q", "least.doc").agg(F.max(F.struct("least.at", "tok")).alias("last")).select("last.tok")


def _size_steps(n: str, percent: int) -> str:
    """How often the least share of similar sizes fits into a size: sizes of a link are one step apart at most."""
    return f"ln({n}) / {math.log(100 / percent) if percent < 100 else 1e-9}"


def links(docs: DataFrame, nodes: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """Verified links (a, b) between nodes (one for each set: node, doc_id, set_key, n_shingles, level, prefix) that connect all
    that is to be connected."""
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # smaller sets are similar to themselves only
    posted = nodes.where(F.col("n_shingles") >= F.lit(least)).select(
        F.posexplode("prefix").alias("pos", "tok"), F.col("node").alias("doc"), (F.col("n_shingles") * 16 + F.col("level")).alias("meta")
    )
    twice = posted.groupBy("tok").agg(F.count("*").alias("n")).where("n > 1").select("tok")
    own = f"meta div 16 - ({percent} * (meta div 16) + 99) div 100 + meta % 16 - count(*) over (partition by doc)"
    common = posted.join(twice, "tok").selectExpr("tok", "doc", "meta", "pos + 1L as pos", f"{own} as u", "row_number() over (partition by doc order by pos) as at")
    alive = common.where(f"100 * (meta div 16 - pos + at) >= {percent} * (meta div 16)")  # what it can share with one that has this token
    x = F.struct(F.col("u"), F.col("doc"), F.expr("meta div 16").alias("n"), F.expr("meta % 16").alias("level"), F.col("at").cast("long").alias("at"), F.col("pos"))
    shared = scratch.table(alive.select("tok", x.alias("y")))

    # The pivot of a token is the document with the fewest tokens of its own: of a group of near copies, a central one.
    pivots = shared.groupBy("tok").agg(F.min("y").alias("x"))
    star = _candidates(shared.join(pivots, "tok").where("x.doc <> y.doc"), percent)
    tried = scratch.table(star)
    found = _verified(tried, nodes, docs, n, percent, scratch)
    component = connected_components(found, scratch)
    placed = scratch.table(
        shared.join(component, F.col("y.doc") == F.col("node"), "left").select("tok", "y", F.coalesce("component", "y.doc").alias("c"))
    )
    mixed = placed.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("tok")
    open_ = scratch.table(placed.join(mixed, "tok", "left_semi").join(_last_of_alike(shared), "tok", "left_semi"))
    # Documents of a token meet by steps of size, the smaller one in its own and the next: each pair once, and only sizes that can link.
    steps = F.expr(_size_steps("y.n", percent))
    smaller = open_.select("tok", F.col("y").alias("x"), F.col("c").alias("cx"), F.explode(F.sequence(F.floor(steps - 1e-9), F.floor(steps + 1 + 1e-9))).alias("step"))
    larger = open_.select("tok", "y", "c", F.floor(steps).alias("step"))
    rest = _late_candidates(smaller.join(larger, ["tok", "step"]).where("(x.n < y.n or x.n = y.n and x.doc < y.doc) and cx <> c"), percent)
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _verified(scratch.table(rest.join(known, ["a", "b"], "left_anti")), nodes, docs, n, percent, scratch)
    for t in (shared, placed, open_):
        scratch.drop(t)
    return found.union(more)


def grouped(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, set_key, part (a number for each component; null: no set or no id), component_id for each row of docs."""
    if not 0 < percent <= 100 or n < 1:
        raise ValueError("percent must be in 1..100 and n positive")
    scratch = Scratch(docs.sparkSession)
    features = scratch.table(_features(docs, sketch(docs, n), n, percent))
    one = features.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "level", "prefix")).alias("x"))
    nodes = scratch.table(one.select(F.monotonically_increasing_id().alias("node"), "set_key", "x.*"))  # numbered once, as written
    component = connected_components(links(docs, nodes, scratch, n, percent), scratch)
    own = nodes.select("node", "set_key", "doc_id").join(component, "node", "left").select("set_key", "doc_id", F.coalesce("component", "node").alias("part"))
    own = scratch.table(own)
    least = own.groupBy("part").agg(F.min("doc_id").alias("smallest"))
    by_set = own.select("set_key", "part").join(least, "part")
    named = F.col("doc_id").isNotNull()
    return features.select("doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left").select(
        "doc_id", "n_shingles", "set_key", F.when(named, F.col("part")).alias("part"), F.when(named, F.coalesce("smallest", "doc_id")).alias("component_id")
    )


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: similarity of at least percent / 100 links two sets."""
    return grouped(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component one row, that of the smallest id (of its smallest set, where the id has
    several texts); rows without a set stay, each id once; rows without an id all stay."""
    scratch = Scratch(docs.sparkSession)
    groups = scratch.table(grouped(docs, n, percent).where("doc_id is not null"))
    several = scratch.table(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    gone = groups.where("doc_id <> component_id").select("doc_id")
    none = several.isEmpty()
    if not none:
        gone = gone.union(several)
    gone = maybe_broadcast(scratch.table(gone.distinct()))
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if none:
        return kept
    # Rows of repeated ids are looked at by their set.
    first = groups.where("part is not null").groupBy("part").agg(F.min(F.struct("doc_id", "set_key")).alias("x")).select("x.*")
    asked = with_set_key(docs.join(maybe_broadcast(several), "doc_id", "left_semi").select(docs.columns), n).withColumn("id", F.col("doc_id").cast("long"))
    once = asked.dropDuplicates(["id", "set_key"])
    with_set = once.join(first.select(F.col("doc_id").alias("id"), "set_key"), ["id", "set_key"], "left_semi")
    return kept.unionByName(with_set.select(docs.columns)).unionByName(once.where("set_key is null").select(docs.columns))
