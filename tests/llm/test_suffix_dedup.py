"""Operator 11 against every pair of strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix_dedup

SCHEMA = "doc_id long, text string, rank int, k1 string, at string"


def plain(rows, least):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + least] for _, b in data for p in range(len(b) - least + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] > 1:
                gone[p : p + least] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, least, parts=3):
    df = spark.createDataFrame([(i, t, 1, "k", "a") for i, t in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r)[:5] for r in suffix_dedup.remove_repeats(df, least).collect()), key=str)


def prose(rng, n, alphabet="abcdefgh éç"):
    return "".join(rng.choice(list(alphabet), n))


def corpus(seed, least):
    """Copies, near copies, passages around the wanted length at all edges, repeats inside a text, periodic texts."""
    rng = np.random.default_rng(seed)
    rows = [prose(rng, int(rng.integers(0, 6 * least))) for _ in range(20)]
    rows += rows[:4] + [rows[4]] * 6
    for t in rows[5:10]:
        at = int(rng.integers(0, max(1, len(t))))
        rows.append(t[:at] + "#" + t[at:])
    for size in (least - 2, least - 1, least, least + 1, least + least // 2, 3 * least):
        passage = prose(rng, size, "abcdefgh ")
        for _ in range(3):
            rows.append(prose(rng, int(rng.integers(0, least))) + passage + prose(rng, int(rng.integers(0, least))))
        rows += [passage, passage[1:], passage + passage]
    long = prose(rng, 4 * least, "abcdefgh ")
    rows += [long[a : a + 2 * least] for a in range(0, 2 * least, max(1, least // 3))]
    rows += ["a" * (least - 1), "a" * (least + 3), "ab" * least, "b" + "ab" * (least // 2), "xyz" * least]
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "least"), [(1, 60), (2, 33), (3, 16), (4, 7)])
def test_equals_plain(spark, seed, least):
    rows = corpus(seed, least)
    assert run(spark, rows, least) == plain(rows, least)


def test_production_length(spark):
    rows = corpus(5, 400)
    assert run(spark, rows, 400, 5) == plain(rows, 400)


def test_odd_rows(spark):
    rng = np.random.default_rng(9)
    a, b = prose(rng, 300), prose(rng, 300)
    rows = [(1, None), (2, ""), (None, None), (None, a), (3, a), (3, a), (3, b), (4, b + "x"), (5, "é" * 90), (6, "short")]
    assert run(spark, rows, 50) == plain(rows, 50)
    assert run(spark, [(1, a), (2, b)], 50) == plain([(1, a), (2, b)], 50)
    assert run(spark, [], 50) == []


def test_long_text(spark):
    """Of a text of megabytes and a piece of it, the piece goes from both."""
    rng = np.random.default_rng(11)
    long = "".join(rng.choice(list("abcdefghijklmnop"), 3_000_000))
    got = {r[0]: r for r in run(spark, [(1, long), (2, long[1_000_000:1_002_000])], 400)}
    assert got[1][1:4] == (3_000_000, 2000, 1) and got[2][1:4] == (2000, 2000, 1)
    assert got[1][4] == hashlib.sha256((long[:1_000_000] + long[1_002_000:]).encode()).hexdigest()


def test_places_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    hashed = rng.integers(0, 2**63, 5000).astype(np.uint64)
    hashed[1000:2000] = hashed[0]
    want = [i + int(np.argmin(hashed[i : i + 20] >> np.uint64(26))) for i in range(4981)]
    assert suffix_dedup.chosen(hashed, 20).tolist() == want
