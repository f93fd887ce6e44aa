"""Ids of the word-level BPE file, looked up chunk by chunk.

The tokenizer lower-cases, drops white space and encodes each match of its pattern on its own, and no match spans white
space. So the ids of a text are those of its chunks between white space, in order, and a chunk is encoded once in a
worker. Texts with anything whose treatment could differ from that (characters beyond Latin-1, control characters,
special tokens written out) go to the tokenizer whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import regex
from tokenizers import Tokenizer

from tidemark.llm.bpe import shortened
from tidemark.llm.common import use_table

#: Chunks that a worker remembers, and half as many words (about 200 bytes each); beyond it, it keeps the short ones.
KNOWN = 1_600_000
#: Characters for which lower-casing, composition and white space are the same everywhere.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
#: Fixed value: the tokenizer file's split pattern.
MATCH = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _words(chunk: str) -> list[str]:
    """The matches in a plain chunk; letters alone, or with one mark after them, need no pattern."""
    if chunk.isalpha():
        return [chunk]
    if chunk[-1] in ".,!?" and chunk[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return MATCH.findall(chunk)


class WordIds:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn_words(self, words: list[str]) -> None:
        """Encode many words in one call; each ends with a token that marks the end of a word."""
        if not words:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        flat = ids.tobytes()
        ends = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        if len(ends) == len(words) + 1 and ends[-1] == len(flat):
            self.words.update((w, flat[a:b]) for w, a, b in zip(words, ends, ends[1:]))  # noqa: B905  pairs of neighbours
        else:
            for w in words:
                self.words[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: set[str], most: int) -> None:
        split = {c: _words(c) for c in chunks}
        words = set().union(*split.values())
        new = words.difference(self.words)
        if len(self.words) + len(new) > most // 2:
            self.words = shortened(self.words, most // 2)
            new = words.difference(self.words)
        self._learn_words(list(new))
        known = self.words.__getitem__
        self.chunks.update((c, b"".join(map(known, w))) for c, w in split.items())

    def _unknown(self, split: Iterable[list[str]]) -> set[str]:
        return set(filterfalse(self.chunks.__contains__, chain.from_iterable(split)))

    def encode(self, texts: list[str], most: int = KNOWN) -> list[bytes]:
        """Ids of each text, without special tokens, as little-endian 32-bit numbers."""
        use_table("words", word_ids.cache_clear)
        plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        split = [t.lower().split() if p else () for t, p in zip(texts, plain, strict=True)]
        found = [list(map(self.chunks.get, s)) for s in split]
        if lacking := [i for i, f in enumerate(found) if None in f]:
            new = self._unknown(split[i] for i in lacking)
            if len(self.chunks) + len(new) > most:
                self.chunks = shortened(self.chunks, most)
                new = self._unknown(split[i] for i in lacking)
            self._learn(new, most)
            for i in lacking:
                found[i] = map(self.chunks.__getitem__, split[i])
        return [
            b"".join(f) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            for t, f, p in zip(texts, found, plain, strict=True)
        ]


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)
