"""Best-fit packing by bin completion.

Documents become token ids and an end id, cut into pieces of at most `capacity`. Full pieces are sequences of their own.
The rest is dealt evenly over shards of a few thousand pieces, and each shard is packed on its own: best fit decreasing
gives the incumbent; if it uses more sequences than the total length needs, a branch and bound fills sequence after
sequence around the largest piece left, over the undominated fillings (no piece in it could be swapped for a longer one
that still fits), least waste first, and leaves a branch once its waste exceeds what a better solution may waste. It opens the
LOOSE_BINS least full sequences of a shard, tries FILLINGS fillings around a piece and BUDGET in all, and keeps the
incumbent beyond. What
stands in the least filled sequence of each shard is packed once more, 64 shards together, so that sequences
which are not full stay few however many shards there are. Only (id, piece, length) rows are shuffled; a shard has a
bounded number of rows whatever the ids are, as rows are dealt by their place in the input and not by a key.

Null text counts as empty: the end id alone. Repeated ids and rows are packed as often as they stand. An empty table
gives an empty result. Lengths over the capacity cannot occur, since documents are cut; capacity must be positive. Texts are
encoded whole, however long. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import as_lists
from tidemark.llm.common import Scratch, slices, small_batches
from tidemark.llm.words import KNOWN, word_ids

SHARD_ROWS = 4096
#: Fillings that the branch and bound looks at in a shard before it keeps the incumbent.
BUDGET = 3000
#: Fillings tried around one piece, and bins (the least full) that are opened again for the search; the others keep their best fit.
FILLINGS = 64
LOOSE_BINS = 120


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, shards: int = 1, with_ids: bool = True, remember: int = KNOWN) -> DataFrame:
    """doc_id, piece, start, length, ids array<int> or ids_crc32, and shard: each document's ids cut into pieces.

    remember: chunks of text whose ids a worker keeps; fewer take less memory and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 7919 * TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, 1):
                ids, number, start, data = [], [], [], []
                end = int(end_id).to_bytes(4, "little")
                encoded = word_ids(path).encode([t or "" for t in part.column(1).to_pylist()], remember)
                for doc, x in zip(part.column(0).to_pylist(), encoded, strict=True):
                    x += end
                    for k in range(0, len(x), 4 * capacity):
                        ids.append(doc)
                        number.append(k // (4 * capacity))
                        start.append(k // 4)
                        data.append(x[k : k + 4 * capacity])
                what = as_lists(data) if with_ids else pa.array([zlib.crc32(x) for x in data], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in data], pa.int64()), what, pa.array((np.arange(at, at + len(ids)) % shards).astype(np.int32))],
                    names=["doc_id", "piece", "start", "length", "ids" if with_ids else "ids_crc32", "shard"],
                )
                at += len(ids)

    schema = f"doc_id long, piece int, start long, length long, {'ids array<int>' if with_ids else 'ids_crc32 long'}, shard int"
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing. Bins of lengths."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    open_ = 0  # bit r: there is a bin with r left
    for x in sorted(lengths, reverse=True):
        fits = open_ >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
            bins[b].append(x)
            left = r - x
        else:
            b, left = len(bins), capacity - x
            bins.append([x])
        if left:
            room[left].append(b)
            open_ |= 1 << left
    return bins


def fillings(counts: Counter, sizes: list[int], room: int, most: int) -> list[list[int]]:
    """Undominated fillings of the room, least waste first: no piece in one could be swapped for a longer one left over that still
    fits. The first found takes the longest pieces that fit; the search ends after `most` of them, or 40 * most steps.

    sizes: in falling order. A size is taken as often as it can be, then once less, and so on, so a step is a size and not a piece.
    """
    found: list[tuple[int, list[int]]] = []
    rising = [-s for s in sizes]
    steps = 0

    def undominated(left: int, chosen: list[tuple[int, int]]) -> bool:
        taken = dict(chosen)
        for c in (0, *taken):
            for s in sizes[bisect_left(rising, -(c + left)) : bisect_left(rising, -c)]:  # longer than c (0: none), and fitting in its place
                if counts[s] > taken.get(s, 0):
                    return False
        return True

    def go(k: int, left: int, chosen: list[tuple[int, int]]) -> bool:
        nonlocal steps
        steps += 1
        k = max(k, bisect_left(rising, -left))  # the first size that fits
        while k < len(sizes) and not counts[sizes[k]]:
            k += 1
        if k == len(sizes):
            if undominated(left, chosen):
                found.append((left, [s for s, n in chosen for _ in range(n)]))
            return len(found) >= most
        s = sizes[k]
        for n in range(min(counts[s], left // s), -1, -1):
            if go(k + 1, left - n * s, [*chosen, (s, n)] if n else chosen) or steps >= 40 * most:
                return True
        return False

    go(0, room, [])
    return [x for _, x in sorted(found, key=lambda f: f[0])]


def complete(lengths: list[int], capacity: int, budget: int = BUDGET) -> list[list[int]]:
    """Bins of lengths, as few as best fit decreasing and the branch and bound find."""
    best = best_fit(lengths, capacity)
    total = sum(lengths)
    least = -(-total // capacity)
    spent = 0

    def search(counts: Counter, bins: list[list[int]], waste: int, left: int) -> None:
        nonlocal best, spent
        may = (len(best) - 1) * capacity - total  # what a better solution may waste
        if not left:
            if len(bins) < len(best):
                best = [list(b) for b in bins]
            return
        if spent >= budget or len(best) == least or waste > may:
            return
        sizes = sorted((s for s, n in counts.items() if n), reverse=True)
        top = sizes[0]
        counts[top] -= 1
        for filling in fillings(counts, sizes, capacity - top, FILLINGS):
            spent += 1
            more = capacity - top - sum(filling)
            if waste + more > may and left > top + sum(filling):
                break
            for s in filling:
                counts[s] -= 1
            bins.append([top, *filling])
            search(counts, bins, waste + more, left - top - sum(filling))
            bins.pop()
            for s in filling:
                counts[s] += 1
            if spent >= budget or len(best) == least:
                break
        counts[top] += 1

    if len(best) > least and lengths:
        # The branch and bound takes the bins where waste gathers; the fullest stay.
        best.sort(key=lambda b: capacity - sum(b))
        keep, loose = best[:-LOOSE_BINS], best[-LOOSE_BINS:]
        if keep:
            return keep + complete([x for b in loose for x in b], capacity, budget)
        search(Counter(lengths), [], 0, total)
    return best


def _pack(capacity: int, last_only: bool):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Sequences are numbered within the shard; sequence -1: the pieces of the least filled one, if they wait."""
        rows = rows.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        bins = complete(rows["length"].tolist(), capacity)
        bins.sort(key=lambda b: capacity - sum(b))
        by = {n: list(g) for n, g in rows.groupby("length").groups.items()}
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for k, b in enumerate(bins):
            wait, place = not last_only and k == len(bins) - 1 and sum(b) < capacity, 0
            for s in sorted(b, reverse=True):
                i = by[s].pop()
                sequence[i], offset[i] = -1 if wait else k, place
                place += s
        return rows.assign(sequence=sequence, offset=offset)

    return pack


def pack(cut: DataFrame, scratch: Scratch, capacity: int = 2048) -> DataFrame:
    """Give each row of cut (doc_id, piece, length, shard and what else it has) a sequence_id and an offset in it.

    cut must be a table (it is read twice). Sequence ids: 3 * ((shard << 32) + number), plus 0 for full pieces, 1 for
    sequences of one shard and 2 for those of the last round.
    """
    names = [c for c in cut.columns if c != "shard"]
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    whole = cut.where(F.col("length") == capacity).select(
        *names, (F.monotonically_increasing_id() * 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    first = (
        cut.where(F.col("length") < capacity)
        .groupBy("shard")
        .applyInPandas(_pack(capacity, False), schema + ", sequence long, offset long")
    )
    first = scratch.table(first)
    done = first.where("sequence >= 0")
    again = (
        first.where("sequence < 0")
        .select(*names, F.expr("shard div 64").cast("int").alias("shard"))
        .groupBy("shard")
        .applyInPandas(_pack(capacity, True), schema + ", sequence long, offset long")
    )
    number = (F.col("shard").cast("long") * F.lit(1 << 32) + F.col("sequence")) * 3
    return (
        whole.unionByName(done.select(*names, (number + 1).alias("sequence_id"), "offset"))
        .unionByName(again.select(*names, (number + 2).alias("sequence_id"), "offset"))
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, remember: int = KNOWN) -> DataFrame:
    """doc_id, piece, start, length, ids (or ids_crc32), sequence_id, offset: all documents in sequences of `capacity`."""
    scratch = Scratch(docs.sparkSession)
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    return pack(scratch.table(pieces(docs, path, capacity, end_id, shards, with_ids, remember)), scratch, capacity)
