"""Prefix trie of conversations in preorder: rank, subtree ends, and differences of prefix sums.

No step holds a conversation, a node's members or its children together. Turns are numbered, and the digests of all
prefixes made, by prefix sums over the globally sorted table, whose partitions add the totals of those before them. Whole
conversations are ranked lexicographically by blocks of sixteen turns, then of sixteen blocks, and so on. A node's members
are the conversations of a range of ranks, so nodes in order of (first rank, depth) stand in preorder, a subtree ends with
the last node whose first rank is the node's last one, and sums over subtrees are differences of two prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, small_batches

#: Turns of a block, and blocks of the next one.
WIDE = 16
#: Ids whose decimal forms are joined at a time.
CHUNK = 1024


def running(df: DataFrame, order: list, keep: list[str], scratch: Scratch, sums: tuple = (), xors: tuple = ()) -> DataFrame:
    """df's columns `keep` with the row's number (`at`, from 0) in the global order and inclusive running sums and xors of
    long columns (`run_<name>`). A range sort, a running total in each partition, and one broadcast row a partition."""
    spark = df.sparkSession
    small_batches(spark)
    done = [f"run_{c}" for c in (*sums, *xors)]
    wanted = list(dict.fromkeys([*keep, *sums, *xors]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last = TaskContext.get().partitionId(), 0, dict.fromkeys((*sums, *xors), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = [batch.column(c) for c in keep]
            for c in (*sums, *xors):
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(x) + last[c] if c in sums else np.bitwise_xor.accumulate(x) ^ last[c]
                last[c] = total[-1]
                out.append(pa.array(total, pa.int64()))
            out += [pa.array(np.arange(seen, seen + batch.num_rows), pa.int64()), pa.array(np.full(batch.num_rows, part), pa.int32())]
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(out, [*keep, *done, "at", "part"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} long" for c in done), "at long", "part int"])
    rows = scratch.table(df.orderBy(*order).select(*wanted).mapInArrow(run, schema))
    ends = rows.groupBy("part").agg(F.max("at").alias("at"), *[F.max_by(c, "at").alias(c) for c in done]).orderBy("part").collect()  # a row a partition
    offsets, now = [], {"at": 0} | dict.fromkeys(done, 0)
    for r in ends:
        offsets.append((r["part"], *now.values()))
        now = {c: now[c] + r[c] + 1 if c == "at" else now[c] ^ r[c] if c[4:] in xors else now[c] + r[c] for c in now}
    before = spark.createDataFrame(offsets, "part int, " + ", ".join(f"b_{c} long" for c in ["at", *done]))
    fixed = [(F.col(c).bitwiseXOR(F.col(f"b_{c}")) if c[4:] in xors else F.col(c) + F.col(f"b_{c}")).alias(c) for c in ["at", *done]]
    return rows.join(F.broadcast(before), "part").select(*keep, *fixed)


def ranked(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct values of column `key` with numbers (`rank`) that grow with them."""
    return scratch.table(keys.select("key").distinct().orderBy("key").withColumn("rank", F.monotonically_increasing_id()))


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (c, j, n1, n2, size) and conversations (c, turns) after each took the first turns of its hundred's first."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = turns.where("c is not null").select("*", F.xxhash64("role", "text").alias("n1"), F.xxhash64(F.lit(1), "text", "role").alias("n2"), F.length("text").cast("long").alias("size"))
    rows = running(named, ["c", F.col("turn").asc_nulls_first(), "role", "text"], ["c", "n1", "n2", "size"], scratch)
    convs = rows.groupBy("c").agg(F.min("at").alias("first"), F.count("*").alias("own")).withColumn("h", F.crc32(F.col("c").cast("string")) % 6).withColumn("base", F.col("c") - F.col("c") % 100)
    convs = scratch.table(convs)
    bases = convs.select(F.col("c").alias("base"), F.col("own").alias("there"), F.col("first").alias("from"))
    convs = scratch.table(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    own = rows.join(convs, "c").withColumn("k", F.col("at") - F.col("first")).where("k >= h").select("c", (F.col("taken") + F.col("k") - F.col("h")).alias("j"), "n1", "n2", "size")
    heads = rows.join(bases, rows.c == bases.base).withColumn("j", F.col("at") - F.col("from")).where("j < 5 AND base % 100 = 0").select("base", "j", "n1", "n2", "size")
    taken = convs.where("taken > 0").select("c", "base", "taken").join(heads, "base").where("j < taken").select("c", "j", "n1", "n2", "size")
    return own.unionByName(taken), convs.select("c", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))


def conversation_ranks(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, rank): equal for equal sequences of turns, else in their lexicographic order, a prefix first. Turns are ordered by
    their digests, which is as good an order as any for a trie."""
    now = turns.select("c", F.col("j").alias("q"), F.struct("n1", "n2").alias("name"))
    while True:
        blocks = now.groupBy("c", F.expr(f"q div {WIDE}").alias("q")).agg(F.array_sort(F.collect_list(F.struct((F.col("q") % WIDE).alias("place"), "name"))).alias("key"))
        blocks = scratch.table(blocks)
        most = blocks.agg(F.max("q")).first()[0]
        names = ranked(blocks, scratch)
        now = blocks.join(names, "key").select("c", "q", F.col("rank").alias("name"))
        if not most:
            return scratch.table(now.select("c", F.col("name").alias("rank")))
        now = scratch.table(now)


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids, joined by commas, of each rank. The hash of one list can't be shared out, so one task
    runs through it, a chunk at a time; the chunks are made everywhere."""
    chunks = ends.groupBy("rank", F.expr(f"c div {CHUNK}").alias("k"), (F.col("c") < 0).alias("minus")).agg(F.sort_array(F.collect_list("c")).alias("ids"))
    texts = chunks.select("rank", F.col("ids")[0].alias("least"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("joined"))
    small_batches(ends.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, digest, out = None, None, []
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.string())], ["rank", "ends_sha256"])
        for batch in batches:
            for r, joined in zip(batch.column("rank").to_pylist(), batch.column("joined").to_pylist(), strict=True):
                if r != rank:
                    if digest is not None:
                        out.append((rank, digest.hexdigest()))
                    rank, digest = r, hashlib.sha256(joined.encode())
                else:
                    digest.update(b"," + joined.encode())
            yield flush(out)
            out = []
        if digest is not None:
            yield flush([(rank, digest.hexdigest())])

    return texts.repartition("rank").sortWithinPartitions("rank", "least").select("rank", "joined").mapInArrow(run, "rank long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    and its place in preorder (preorder, subtree_end: the first and last node of its subtree).

    Turns of one conversation are ordered by turn (null first), then role and text, repeated rows included; a null role or
    text is an empty one. Rows without a conv_id belong to no conversation. A conversation left without turns is a member of
    the root alone. An empty table has no node. Other columns are ignored. Equal prefixes are recognised by 128 bits of
    digests of role, text and place."""
    scratch = Scratch(conversations.sparkSession)
    turns, convs = rebuilt(conversations, scratch)
    place = lambda *c: F.xxhash64(*c)
    turns = scratch.table(turns.select("*", place("j", "n1").alias("x1"), place("n2", "j").alias("x2")))
    ranks = convs.join(conversation_ranks(turns, scratch), "c", "left").select("c", "turns", F.coalesce("rank", F.lit(-1)).alias("rank"))
    ranks = scratch.table(ranks)
    xored = running(turns, ["c", "j"], ["c", "j", "size", "x1", "x2"], scratch, xors=("x1", "x2"))
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    starts = xored.where("j = 0").select("c", xor("run_x1", "x1").alias("s1"), xor("run_x2", "x2").alias("s2"))
    paths = xored.join(starts.join(ranks, "c"), "c").select(
        "c", "rank", (F.col("j") + 1).alias("depth"), xor("run_x1", "s1").alias("y1"), xor("run_x2", "s2").alias("y2"), "x1", "x2", "size"
    )
    root = ranks.select("c", "rank", *[F.lit(0).cast("long").alias(n) for n in ("depth", "y1", "y2", "x1", "x2", "size")])
    nodes = paths.unionByName(root).groupBy("depth", "y1", "y2").agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"),
        *[F.min(n).alias(n) for n in ("x1", "x2", "size")],
    )
    nodes = scratch.table(nodes.select("*", xor("y1", "x1").alias("p1"), xor("y2", "x2").alias("p2")))
    key = lambda a, depth: [depth.alias("depth"), F.col(f"{a}1").alias("y1"), F.col(f"{a}2").alias("y2")]
    inner = nodes.where("depth > 0")
    children = inner.groupBy(*key("p", F.col("depth") - 1)).agg(F.count("*").alias("n_children"))
    owners = nodes.join(children, ["depth", "y1", "y2"]).select((F.col("depth") + 1).alias("depth"), F.col("y1").alias("p1"), F.col("y2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    nodes = nodes.join(children, ["depth", "y1", "y2"], "left").join(owners, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "first", "last",
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saving"),
    )
    keep = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "first", "last", "leaf", "saving"]
    placed = running(nodes, ["first", "depth"], keep, scratch, sums=("leaf", "saving"))
    until = placed.groupBy(F.col("first").alias("last")).agg(*[F.max(c).alias(f"end_{c}") for c in ("at", "run_leaf", "run_saving")])
    digests = ranks.select(F.col("rank").alias("first"), F.col("turns").alias("depth")).distinct().join(_digests(ranks).withColumnRenamed("rank", "first"), "first")
    total = lambda c: (F.col(f"end_run_{c}") - F.col(f"run_{c}") + F.col(c)).cast("long")
    return placed.join(until, "last").join(digests, ["first", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("leaf").alias("n_leaves"), total("saving").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.col("at").alias("preorder"), F.col("end_at").alias("subtree_end"),
    )
