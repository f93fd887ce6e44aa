"""Byte-level BPE by corpus-level merge replay.

The distinct words of a slice of the corpus that are not known yet are laid end to end. An inverted index maps each
token pair (by the rank it merges to) to the positions where it stands; ranks are taken in order, each is applied to all
its positions at once over all words, and only the two neighbours of a merged pair are looked up and indexed anew.
Where a merge brings forth a pair of lower rank than its own, the word's own order of merges can differ from the
corpus-wide one; those words are encoded again one by one. Every word is encoded once in a worker and then looked up,
so the work follows the number of distinct words; no rows are shuffled.

Null text counts as empty: no tokens, decoded to no bytes. Rows are kept one to one, repeated ids included; other
columns are not read. An empty table gives an empty result. Memory: a slice of texts, its words, and a bounded table of known words.
"""

from __future__ import annotations

import base64
import bisect
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_text, use_table

SHIFT = 21
#: Words that a worker remembers (about 200 bytes each); beyond it, it keeps those of few characters, which recur most.
KNOWN_WORDS = 1_000_000
SHORT = 8
#: Texts beyond so many characters are split into words piece by piece.
LONG_TEXT = 4_000_000


def shortened(known: dict[str, bytes], most: int) -> dict[str, bytes]:
    """The short words of a full table, or none if those alone would fill half of it."""
    short = {w: x for w, x in known.items() if len(w) <= SHORT}
    return short if len(short) <= most // 2 else {}


class Vocabulary:
    """A rank file: its tokens, and which neighbours merge to which rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(pattern)
        self.token = {r: t for t, r in self.ranks.items()}
        if len(self.token) != len(self.ranks) or max(self.token) >= 1 << SHIFT:
            raise ValueError(f"{path}: ranks repeat or are too large")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pair = {}
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None:
                    self.pair[a << SHIFT | b] = r
        self.first = np.array([[self.pair.get(int(a) << SHIFT | int(b), -1) for b in self.byte] for a in self.byte])
        self.known: dict[str, bytes] = {}

    def alone(self, word: bytes) -> list[int]:
        """One word by its own order of merges: lowest rank first, leftmost among equals."""
        ids = [int(self.byte[b]) for b in word]
        while len(ids) > 1:
            rank, at = min(((self.pair.get(ids[i] << SHIFT | ids[i + 1], 1 << SHIFT), i) for i in range(len(ids) - 1)))
            if rank == 1 << SHIFT:
                break
            ids[at : at + 2] = [rank]
        return ids

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (none empty), all merged together rank by rank, as little-endian 32-bit numbers."""
        joined = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        tok = self.byte[joined]
        follows = np.arange(1, len(joined) + 1)
        before = np.arange(-1, len(joined) - 1)
        follows[starts + sizes - 1] = -1
        before[starts] = -1
        rank = np.full(len(joined), -1, dtype=np.int64)
        rank[:-1] = self.first[joined[:-1], joined[1:]]
        rank[starts + sizes - 1] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        index = {int(rank[x[0]]): x.tolist() for x in np.split(at, cuts) if len(x)}
        odd: set[int] = set()
        tok, follows, before = tok.tolist(), follows.tolist(), before.tolist()
        find, queue = self.pair.get, list(index)
        heapify(queue)
        while queue:
            r = heappop(queue)
            for p in sorted(index.pop(r)):
                q = follows[p]
                if q < 0 or tok[p] < 0 or find(tok[p] << SHIFT | tok[q]) != r:
                    continue
                tok[p], tok[q] = r, -1
                follows[p] = n = follows[q]
                if n >= 0:
                    before[n] = p
                    if (k := find(r << SHIFT | tok[n])) is not None:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            heappush(queue, k)
                        if k < r:
                            odd.add(p)
                if (o := before[p]) >= 0 and (k := find(tok[o] << SHIFT | r)) is not None:
                    if k in index:
                        index[k].append(o)
                    else:
                        index[k] = [o]
                        heappush(queue, k)
                    if k < r:
                        odd.add(p)
        left = np.array(tok, dtype=np.int64)
        ends = np.cumsum(np.add.reduceat(left >= 0, starts)).tolist()
        flat = left[left >= 0].astype("<u4").tobytes()
        out = [flat[4 * i : 4 * k] for i, k in zip([0, *ends], ends)]  # noqa: B905  the last end begins nothing
        firsts = starts.tolist()
        for i in {bisect.bisect_right(firsts, p) - 1 for p in odd}:
            out[i] = np.array(self.alone(words[i]), dtype="<u4").tobytes()
        return out

    def learn(self, words: set[str]) -> None:
        """Put the ids of new words, as little-endian 32-bit numbers, into the table of known words."""
        whole, rest = {w: w.encode() for w in words}, []
        for w, b in whole.items():
            if (r := self.ranks.get(b)) is not None:
                self.known[w] = r.to_bytes(4, "little")
            else:
                rest.append(w)
        if rest:
            self.known.update(zip(rest, self.replay([whole[w] for w in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        use_table("bpe", forget)
        if any(len(t) > LONG_TEXT for t in texts):
            return [self._long(t) if len(t) > LONG_TEXT else self.encode([t])[0] for t in texts]
        split = [self.pattern.findall(t) for t in texts]
        return self._look_up(split)

    def _long(self, text: str) -> bytes:
        found, out = (m[0] for m in self.pattern.finditer(text)), []
        while words := list(islice(found, 200_000)):
            out += self._look_up([words])
        return b"".join(out)

    def _look_up(self, split: list[list[str]]) -> list[bytes]:
        if new := set().union(*split).difference(self.known):
            if len(self.known) + len(new) > KNOWN_WORDS:
                short = shortened(self.known, KNOWN_WORDS)
                self.known.clear()
                self.known.update(short)
                new = set().union(*split).difference(self.known)
            self.learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path, pattern)


def forget() -> None:
    """Drop the vocabularies and what they know, when another operator takes over the worker."""
    vocabulary.cache_clear()


def as_lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id, ids array<int>, and, if asked for, decoded binary: the bytes that the ids stand for."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(path, pattern)
        ids = vocab.encode([t or "" for t in batch.column(1).to_pylist()])
        columns = [batch.column(0), as_lists(ids)]
        if decoded:
            columns.append(pa.array([vocab.decode(x) for x in ids], type=pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return map_text(
        docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], step,
        "doc_id long, ids array<int>" + ", decoded binary" * decoded,
    )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded, the bytes of ids array<int>; null ids decode to no bytes, unknown ids fail."""

    def run(batches):
        vocab = vocabulary(path, pattern)
        for batch in batches:
            out = [vocab.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
