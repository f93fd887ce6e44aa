"""Token counts by section, attributed through character offsets.

A document is encoded once and whole, so that counts do not depend on where sections begin. Each token covers the
characters that it has bytes of; sections are half-open character intervals that tile the text, here its lines (a line
end belongs to the line that it ends). Both are ordered, so the interval join is a search of token ends among section
starts. A token that crosses a boundary goes to the section that holds most of its characters, the earlier one in a tie;
so every token is counted once, and the counts of the sections add up to the count of the document.

Null text counts as empty: one section without tokens. Rows are treated one by one, repeated and null ids included; texts are
encoded whole, however long. Other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import vocabulary
from tidemark.llm.common import map_text


def line_starts(text: str) -> np.ndarray:
    """Where the lines of a text begin; an empty last line is none."""
    out, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(out, dtype=np.int64)


@lru_cache(maxsize=4)
def _token_sizes(path: str, pattern: str) -> np.ndarray:
    token = vocabulary(path, pattern).token
    out = np.zeros(max(token) + 1, dtype=np.int64)
    out[list(token)] = [len(t) for t in token.values()]
    return out


def spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens whose byte sizes are given."""
    ends = np.cumsum(sizes)
    if text.isascii():
        return ends - sizes, ends
    first = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
    char = np.cumsum(first) - 1
    return char[ends - sizes], char[ends - 1] + 1


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The section of each token; starts: of the sections, which tile [0, size)."""
    low = np.searchsorted(starts, begin, "right") - 1
    high = np.searchsorted(starts, end - 1, "right") - 1
    bounds = np.append(starts, size)
    for i in np.flatnonzero(high > low):
        parts = [min(end[i], bounds[k + 1]) - max(begin[i], bounds[k]) for k in range(low[i], high[i] + 1)]
        low[i] += int(np.argmax(parts))
    return low


def count(
    docs: DataFrame, path: str, pattern: str, sections: Callable[[str], np.ndarray] = line_starts
) -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens: a row for each section of each document."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        sizes = _token_sizes(path, pattern)
        ids, number, start, stop, tokens = [], [], [], [], []
        for doc, text, x in zip(batch.column(0).to_pylist(), texts, vocabulary(path, pattern).encode(texts), strict=True):
            starts = sections(text)
            found = attribute(*spans(text, sizes[np.frombuffer(x, dtype="<u4")]), starts, len(text)) if x else np.empty(0, dtype=np.int64)
            ids += [doc] * len(starts)
            number.append(np.arange(len(starts)))
            start.append(starts)
            stop.append(np.append(starts[1:], len(text)))
            tokens.append(np.bincount(found, minlength=len(starts)))
        joined = [pa.array(np.concatenate(x).astype(np.int64)) for x in (number, start, stop, tokens)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), joined[0].cast(pa.int32()), *joined[1:]], names=["doc_id", "section", "start_char", "end_char", "n_tokens"]
        )

    return map_text(
        docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"], step,
        "doc_id long, section int, start_char long, end_char long, n_tokens long",
    )
