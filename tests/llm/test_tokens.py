"""Operators 3 and 4 against the libraries, and packing against plain rules."""

import base64
import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, queries, words

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "a", "aaaaaaaaaaaaaaaaaaaaa", "don't WE'LL \t\r\n 1234567 '''s !!'s", "x<|endoftext|>y", "日本語 😀😀  é́ ﬁ x\x1cy\x85z ½ª ÀÿſK", "ab " * 9000]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(spark, texts):
    extra = [(i if i != 3 else 2, t, i, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(extra, "doc_id long, text string, n_tokens int, ids string")


def test_bpe_equals_library(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op4_byte_bpe(spark, sf).collect():
        ids = reference.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_bpe_odd_texts(spark, reference):
    df = rows(spark, ODD)
    got = bpe.encode(df, RANKS, P.PATTERN, decoded=True).collect()
    assert sorted(r.ids for r in got) == sorted(reference.encode_ordinary(t or "") for t in ODD)
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for t in ODD)
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for t in ODD)
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(reference, text):
    vocab = bpe.vocabulary(RANKS, P.PATTERN)
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(vocab.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_replay_where_word_order_differs(tmp_path):
    """A merge that brings forth a pair of lower rank must not change the result."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ab", b"cd", b"abcd"]
    order = {**{t: i for i, t in enumerate(tokens[:256])}, b"abc": 256, b"ab": 257, b"cd": 300, b"abcd": 299, b"bc": 400}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in order.items()))
    vocab = bpe.Vocabulary(str(path), P.PATTERN)
    lib = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=order, special_tokens={})
    for text in ("abcabcd", "ababcd", "xabcdcdab", "bcdabcabab", "aabbccdd"):
        assert np.frombuffer(vocab.encode([text])[0], "<u4").tolist() == lib.encode_ordinary(text)


def test_long_text_in_parts(monkeypatch, reference):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    text = "The quick  brown\n fox 123 " * 50
    assert np.frombuffer(bpe.Vocabulary(RANKS, P.PATTERN).encode([text, "a"])[0], "<u4").tolist() == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    known = words.word_ids(WORDS)
    assert np.frombuffer(known.encode([text])[0], "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(got, texts):
    tokenizer = Tokenizer.from_file(WORDS)
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted(docs[doc], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(i, k, min(2048, len(ids) - k)) for i, k in enumerate(range(0, len(ids), 2048))]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine]
    return len(bins), sum(r.length for r in got)


def test_packing_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bins, total = check_packing(queries.op3_best_fit_packing(spark, sf).collect(), texts)
    assert bins <= -(-total // 2048) + 1


def test_packing_odd_rows(spark):
    df = rows(spark, ODD).where("doc_id <> 2")
    texts = {r.doc_id: r.text for r in df.collect()}
    check_packing(packing.pack_documents(df, WORDS, with_ids=False).collect(), texts)
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0
    twice = packing.pack_documents(rows(spark, ["same words"] * 2).withColumn("doc_id", packing.F.lit(None).cast("long")), WORDS).collect()
    assert len(twice) == 2 and {tuple(r.ids) for r in twice} == {tuple(twice[0].ids)}


def test_many_shards_keep_few_loose_ends(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    df = rows(spark, [f"{i} " * (i % 97 + 3) for i in range(400)]).withColumn("doc_id", packing.F.col("n_tokens").cast("long"))
    texts = {r.doc_id: r.text for r in df.collect()}
    bins, total = check_packing(packing.pack_documents(df, WORDS, with_ids=False).collect(), texts)
    assert bins <= -(-total // 2048) + 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=14))
def test_completion_is_never_worse(lengths):
    got = packing.complete(lengths, 100)
    assert sorted(x for b in got for x in b) == sorted(lengths) and all(sum(b) <= 100 for b in got)
    assert len(got) <= len(packing.best_fit(lengths, 100))


def test_completion_beats_best_fit():
    """Best fit decreasing needs one more bin here than there must be."""
    lengths = [51, 27, 12, 10] * 6 + [52, 24, 24] * 6 + [34, 33, 33] * 4
    assert len(packing.complete(lengths, 100)) == 16 == -(-sum(lengths) // 100)


def all_undominated(sizes, room):
    """Every maximal filling without a piece that a longer one left over could replace, by trying all."""
    import itertools
    from collections import Counter

    out = set()
    for pick in itertools.product(*[range(n + 1) for n in sizes.values()]):
        taken = dict(zip(sizes, pick, strict=True))
        left = room - sum(s * n for s, n in taken.items())
        spare = [s for s, n in sizes.items() if n > taken[s]]
        if left >= 0 and not any(s <= left for s in spare) and not any(n and c < s <= c + left for c, n in taken.items() for s in spare):
            out.add(tuple(sorted(Counter(taken).elements(), reverse=True)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 70))
def test_fillings_are_the_undominated_ones(sizes, room):
    from collections import Counter

    got = [tuple(sorted(f, reverse=True)) for f in packing.fillings(Counter(sizes), sorted(sizes, reverse=True), room, 10_000)]
    assert len(got) == len(set(got)) and set(got) == all_undominated(sizes, room)
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_fillings_of_many_pieces():
    from collections import Counter

    assert packing.fillings(Counter({1: 5000}), [1], 2000, 64) == [[1] * 2000]
    many = Counter({s: 1 for s in range(1, 301)})
    got = packing.fillings(many, sorted(many, reverse=True), 1500, 64)
    assert len(got) == 64 and sum(got[0]) == 1500


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidemark.llm.common import scratch_root

    session = lambda master, named: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None), conf=SimpleNamespace(get=lambda k, d: named))
    with pytest.raises(RuntimeError):
        scratch_root(session("spark://host:7077", None))
    assert scratch_root(session("spark://host:7077", "hdfs://shared")) is None and scratch_root(session("local[4]", None)) is None


def test_tokenizer_file_is_as_assumed():
    spec = json.load(open(WORDS))
    assert [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
    assert spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] == "Removed"
