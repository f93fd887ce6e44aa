"""Exact removal of long repeated byte strings by prefix doubling over sampled positions.

A table of one row a byte would be many times the corpus, so positions are sampled by content: of every `span` neighbouring
positions, the one whose sixteen bytes hash lowest (the leftmost, if several do). Two equal strings of `least` bytes so
choose the same place, whatever stands around them, and each start of a string belongs to one sampled position, its anchor,
at most span - 1 bytes on. All bytes from an anchor that such a string must have are `least - span + 1`.

Rounds go over anchors. Their ranks are those of their first `half` bytes; then of pairs of that rank and of what stands
`half` bytes further on, which is past what all strings of an anchor share. Spark sorts the distinct pairs to number them,
and anchors whose rank is theirs alone leave the table. The last round goes to `least` bytes. Where everything that an
anchor's starts reach stands elsewhere too, they are settled as one; the rest, at the edges of repeated passages, is
narrowed in blocks of sixteen starts and at last start by start.

A text is known by 128 bits of its digest; equal texts are so many rows of one key, and count as often as they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, Scratch, maybe_broadcast, slices, small_batches

GRAM = 16
#: Starts that are looked at together where a range as a whole has no equal.
BLOCK = 16
KEY = ["k1", "k2"]
UNIT = [*KEY, "at", "lo", "hi"]
ANCHORS = "k1 long, k2 long, at int, lo int, hi int, f1 long, f2 long, g1 long, g2 long"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def fingerprints(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64 bits of the `size` (8 at least) bytes from each of the positions on."""
    out = np.full(len(at), size, dtype=np.uint64)
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        out = _mix(out ^ words[at + k])
    return out.view(np.int64)


def lowest(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every `span` neighbours."""
    have = 1
    while have < span:
        step = min(have, span - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def chosen(hashed: np.ndarray, span: int) -> np.ndarray:
    """Of every `span` neighbours, the place of the lowest by its upper 38 bits, of several the leftmost; in blocks, so that
    the place in a block fits the other bits."""
    place, step, out = np.uint64((1 << 26) - 1), 1 << 25, []
    for a in range(0, len(hashed) - span + 1, step):
        part = hashed[a : a + step + span - 1]
        out.append((lowest((part & ~place) | np.arange(len(part), dtype=np.uint64), span) & place).astype(np.int64) + a)
    return np.concatenate(out)


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int, span: int) -> tuple[np.ndarray, ...]:
    """Of texts that stand one behind the other in data: each anchor's text, place, and first and last start (places in data)."""
    gram = min(GRAM, least)
    fits = ends - begins >= least
    if not fits.any():
        return (np.zeros(0, dtype=np.int64),) * 4
    words = _words(np.concatenate([data, np.zeros(8, dtype=np.uint8)]))
    n = len(data) - gram + 1
    hashed = _mix(words[:n] ^ _mix(words[gram - 8 : gram - 8 + n])) if gram > 8 else _mix(words[:n] & np.uint64((1 << 8 * gram) - 1))
    who = chosen(hashed, span)
    text = np.repeat(np.flatnonzero(fits), (ends - begins - least + 1)[fits])
    first = np.cumsum(np.r_[0, (ends - begins - least + 1)[fits]])[:-1]
    starts = np.arange(len(text)) - np.repeat(first, np.diff(np.r_[first, len(text)])) + begins[text]
    anchor = who[starts]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    opens = np.flatnonzero(new)
    closes = np.r_[opens[1:], len(text)] - 1
    return text[opens], anchor[opens], starts[opens], starts[closes]


def _digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each stretch, two longs a row."""
    view, blake = memoryview(data).cast("B") if len(data) else memoryview(b""), hashlib.blake2b
    joined = b"".join(blake(view[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(joined, dtype="<i8").reshape(-1, 2)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins (and the last ends)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def span_of(least: int) -> int:
    """Seven tenths of the length: what an anchor's strings share are the other three."""
    return max(1, min(7 * least // 10, least - min(GRAM, least) + 1))


def sampled(texts: DataFrame, least: int) -> DataFrame:
    """Anchors of texts (k1, k2, text): place, first and last start, fingerprints of the first half that all their strings
    share and of the other half, digest of all that they reach."""
    span = span_of(least)
    shared = least - span + 1
    half = max(min(8, shared), shared // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                data, at = _buffer(batch.column(2))
                text, anchor, lo, hi = anchors(data, at[:-1], at[1:], least, span)
                words = _words(np.concatenate([data, np.zeros(8, dtype=np.uint8)])) if len(anchor) else np.zeros(0, dtype=np.uint64)
                if shared >= 8:
                    f1, f2 = fingerprints(words, anchor, half), fingerprints(words, anchor + shared - half, half) if 2 * half >= shared else fingerprints(words, anchor + half, shared - half)
                else:
                    f1 = f2 = _digests(data, anchor, anchor + shared)[:, 0]
                g = _digests(data, lo, hi + least)
                own = lambda x: pa.array(x.astype(np.int32))  # noqa: E731, B023
                keys = [batch.column(k).take(pa.array(text)) for k in (0, 1)]
                base = at[:-1][text]
                yield pa.RecordBatch.from_arrays(
                    [*keys, own(anchor - base), own(lo - base), own(hi - base), *map(pa.array, (f1, f2, np.ascontiguousarray(g[:, 0]), np.ascontiguousarray(g[:, 1])))],
                    ["k1", "k2", "at", "lo", "hi", "f1", "f2", "g1", "g2"],
                )

    return texts.select("k1", "k2", "text").mapInArrow(run, ANCHORS)


def rerank(positions: DataFrame, pair: list[str], scratch: Scratch) -> DataFrame:
    """Positions whose pair stands more than once, with the pair's number in the order of all such pairs (`rank`).

    Pairs are counted before they meet, so one that all positions share is one row a task; joining it back is a join that
    Spark can split."""
    repeated = positions.groupBy(*pair).agg(F.count("*").alias("times")).where("times > 1")
    names = scratch.table(repeated.drop("times").orderBy(*pair).withColumn("number", F.monotonically_increasing_id()))
    return positions.join(maybe_broadcast(names), pair).drop("rank").withColumnRenamed("number", "rank")


def _units(todo: DataFrame, texts: DataFrame, least: int, size: int, scratch: Scratch) -> DataFrame:
    """The listed ranges of starts (k1, k2, at, lo, hi, edge) cut into blocks of `size` distances from their anchors: digests of
    what all strings of a block share (c1, c2), whatever part of the block the range has, and of all that its own starts reach
    (g1, g2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                cols, digests = [], []
                k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, ranges in enumerate(batch.column(2).to_pylist()):
                    data = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint8)
                    for r in ranges:
                        near = np.arange((r["at"] - r["hi"]) // size, (r["at"] - r["lo"]) // size + 1) * size
                        lo, hi = np.maximum(r["at"] - near - size + 1, r["lo"]), np.minimum(r["at"] - near, r["hi"])
                        full = lambda v: np.full(len(near), v)  # noqa: E731, B023
                        cols.append((full(k1[i]), full(k2[i]), full(r["at"]), lo, hi, full(r["edge"])))
                        digests.append((_digests(data, r["at"] - near, r["at"] - near - size + 1 + least), _digests(data, lo, hi + least)))
                if cols:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
                    both = [np.ascontiguousarray(np.concatenate([d[k] for d in digests])[:, j]) for k in (0, 1) for j in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c), k) for c, k in zip(zip(*cols, strict=True), kinds, strict=True)), *map(pa.array, both)], [*UNIT, "edge", "c1", "c2", "g1", "g2"])

    lists = scratch.table(todo.groupBy(*KEY).agg(F.collect_list(F.struct("at", "lo", "hi", "edge")).alias("ranges")))  # anchors of one text
    return _with_texts(lists, texts, "ranges").mapInArrow(run, "k1 long, k2 long, at int, lo int, hi int, edge boolean, c1 long, c2 long, g1 long, g2 long")


def _with_texts(lists: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """lists (k1, k2, column) with their texts: of the rows of one text, that of the smallest id (rows of one id and text come
    more than once). If the lists are short enough to be sent to all tasks, no text moves."""
    keys = lists.select(*KEY)
    held = lists.agg(F.sum(F.size(column) + 1)).first()[0] or 0
    few = texts.join(maybe_broadcast(keys), KEY, "left_semi")
    firsts = few.groupBy(*KEY).agg(F.min("doc_id").alias("one"))
    wanted = lists.join(firsts, KEY).select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "one", column)
    own = (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")) & F.col("doc_id").eqNullSafe(F.col("one"))
    return few.join(F.broadcast(wanted) if held <= BROADCAST_ROWS else wanted, own).select("k1", "k2", column, "text")


def settle(units: DataFrame, core: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of units with what their strings share (core) and all that they reach (g1, g2): those edges all of whose starts stand
    elsewhere too (k1, k2, lo, hi), and the units to look into (k1, k2, at, lo, hi, edge): edges with a partner of the same core,
    and one of each group of equals among such partners, to compare them with."""
    same = [*core, "g1", "g2"]
    groups = scratch.table(units.groupBy(*same).agg(F.count("*").alias("times"), F.max("edge").alias("edge"), F.min(F.struct(*UNIT)).alias("one")))
    alone = F.col("edge") & (F.col("times") == 1)
    contested = groups.groupBy(*core).agg(F.count("*").alias("n"), F.count_if(alone).alias("left")).where("n > 1 and left > 0").select(*core)
    todo = groups.join(maybe_broadcast(scratch.table(contested)), core, "left_semi").select("one.*", alone.alias("edge"))
    equals = groups.where("times > 1 and edge").select(*same)
    return units.where("edge").join(maybe_broadcast(equals), same, "left_semi").select(*KEY, "lo", "hi"), todo


def repeats(texts: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Stretches (k1, k2, lo, hi) of texts (k1, k2, doc_id, text), first and last start, whose starts' strings stand elsewhere too.

    Between the two, starts may be missing, but never so many that a byte between them is not covered."""
    every = scratch.table(sampled(texts, least))
    positions = rerank(every.withColumn("rank", F.lit(0).cast("long")), ["f1"], scratch)
    positions = scratch.table(rerank(scratch.table(positions), ["rank", "f2"], scratch).select(*UNIT, F.lit(True).alias("edge"), "rank", "g1", "g2"))
    scratch.drop(every)
    whole, todo = settle(positions, ["rank"], scratch)
    blocks = scratch.table(_units(todo, texts, least, min(BLOCK, least), scratch))
    parts, todo = settle(blocks, ["c1", "c2"], scratch)
    starts = scratch.table(_units(todo, texts, least, 1, scratch).drop("c1", "c2", "at", "hi"))
    again = starts.groupBy("g1", "g2").agg(F.count("*").alias("times"), F.max("edge").alias("edge")).where("times > 1 and edge").select("g1", "g2")
    singles = starts.where("edge").join(maybe_broadcast(scratch.table(again)), ["g1", "g2"], "left_semi").select(*KEY, "lo", F.col("lo").alias("hi"))
    return whole.distinct().unionByName(parts).unionByName(singles)


def _merged(stretches: DataFrame, least: int) -> DataFrame:
    """(k1, k2, removed): of each text the maximal runs of bytes that the stretches' strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(2).to_pylist():
                runs: list[list[int]] = []
                for a, b in sorted((s["lo"], s["hi"] + least) for s in spans):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                out.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["k1", "k2", "removed"])

    lists = stretches.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # anchors of one text
    return lists.select(*KEY, "spans").mapInArrow(run, "k1 long, k2 long, removed array<array<int>>")


def remove_repeats(documents: DataFrame, least: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row, its text as UTF-8 bytes without every byte that a string
    of `least` bytes covers which also starts anywhere else, in the same text or another, overlapping or not.

    A null text is an empty one; texts of fewer than `least` bytes keep all. Rows are judged one by one: of repeated rows
    each repeats the others, whatever their ids, null ids included. A text of any length is looked at whole, in the
    memory of one task. An empty table gives no rows; other columns are ignored."""
    if least < 1:
        raise ValueError("strings of one byte at least")
    spark = documents.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    long_ones = rows.where(F.octet_length("text") >= least)
    lists = scratch.table(_merged(repeats(long_ones, least, scratch), least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                out = []
                for i, runs in enumerate(batch.column(2).to_pylist()):
                    data = memoryview(batch.column(3)[i].as_buffer())
                    kept, end = hashlib.sha256(), 0
                    for a, b in [*runs, [len(data), len(data)]]:
                        kept.update(data[end:a])
                        end = b
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), sum(b - a for a, b in runs), runs, kept.hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["k1", "k2", "n_removed", "removed", "kept_sha256"])

    done = _with_texts(lists, long_ones, "removed").mapInArrow(run, "k1 long, k2 long, n_removed long, removed array<array<int>>, kept_sha256 string").dropDuplicates(KEY)
    facts = rows.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return facts.join(scratch.table(done), KEY, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<array<int>>")).alias("removed"),
    )
