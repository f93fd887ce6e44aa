"""Operator 13 against a trie built in a dictionary."""

import hashlib
import zlib

import numpy as np

from tidemark.llm import prefix_trie
from tidemark.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, depth int, rank string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children), len(leaves), saved, digest))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)
    got = prefix_trie.trie(df).collect()
    assert sorted(r.preorder for r in got) == list(range(len(got)))
    assert all(r.preorder <= r.subtree_end for r in got)
    return sorted((tuple(r)[:8] for r in got), key=str)


def conversations(seed, n, longest=8, words=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(1000, n, replace=False).tolist():
        for t in range(int(rng.integers(1, longest))):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", "éa" * int(rng.integers(0, words))))
    return rows


def test_equals_plain(spark):
    for seed in (1, 2):
        rows = conversations(seed, 120)
        assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = conversations(3, 60)
    rows += [(None, 0, "user", "a"), (None, None, None, None), (5, None, None, None), (5, None, "user", None), (5, 3, None, "x"), (5, 3, "bot", "x"), (5, 3, "bot", "x")]
    rows += [(2000 + i, 0, "user", "same") for i in range(40)] + [(7, t, "u", "long" * 4000) for t in range(3)]
    rows += [(-3, 0, "user", "a"), (-250, 0, "user", "b"), (-250, 1, "user", "c")]
    rows = list({(c, t, r, x, i if c == 5 else 0): (c, t, r, x) for i, (c, t, r, x) in enumerate(rows)}.values())
    plain_mod = [(c, t, r, x) for c, t, r, x in rows if c is None or c >= 0]
    assert run(spark, plain_mod) == plain(plain_mod)
    assert sum(r[1] == 0 for r in run(spark, rows)) == 1  # ids below 0 do no harm
    assert run(spark, rows * 2, 1) == run(spark, rows * 2, 5)


def test_long_and_shared_conversations(spark):
    """More turns than a block of blocks, equal up to the last turn; many conversations that are one."""
    rows = [(c, t, "u", f"{t % 7}" if t < 290 or c % 3 else f"{c}") for c in (100, 101, 102, 103, 300) for t in range(300)]
    rows += [(1000 + c, t, "u", "hot") for c in range(150) for t in range(4)]
    assert run(spark, rows) == plain(rows)


def test_turnless(spark):
    gone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    assert run(spark, [(gone, 0, "u", "a")]) == plain([(gone, 0, "u", "a")])
    assert len(run(spark, [(gone, 0, "u", "a")])) == 1
    both = [(gone, 0, "u", "a"), (1000, 0, "u", "b"), (1001, 0, "u", "b")]
    assert run(spark, both) == plain(both)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "u", "a")]) == []


def test_running_totals(spark):
    """Over many partitions, the same as over one."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(-100, 100, 1000), rng.integers(-(2**62), 2**62, 1000)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i long, x long, y long").repartition(7)
    got = prefix_trie.running(df, ["i"], ["i"], Scratch(spark), sums=("x",), xors=("y",)).orderBy("i").collect()
    assert [r["at"] for r in got] == list(range(1000))
    assert [r["run_x"] for r in got] == np.cumsum(x).tolist()
    assert [r["run_y"] for r in got] == np.bitwise_xor.accumulate(y).tolist()
