"""Counterfactually regularised toxicity classifier.

A logistic regression on the words of a text and the first characters of its words. It is fitted on a bounded sample of
labelled rows (SAMPLE rows, those whose ids hash lowest), none of them from the held-out fold. Features are the FEATURES
words or beginnings that tell the classes apart best in the sample (three rows at least, more than three deviations), and all
identity terms. The loss has a second
part: in sentences of the sample that name a group, the term is swapped for another one of its language (English, German, French,
Spanish) and left out, and into one that names none a term is put; the squared change of the sentence's score is penalised,
so that a neutral mention of a group does not move the score.
The fitted weights are a bounded table that goes to all tasks; scoring is one pass over whole texts without a shuffle.

Only the text is an input of a score. Null text counts as empty and gets the score of a text without known features.
Labels that are null are not learned from; of several labels of an id the largest counts. Without labelled rows of
both classes the score is 0 for all rows. Rows are scored one by one, repeated and null ids included; texts whole, however
long, in slices of bounded bytes. Other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, map_text, small_batches, use_table

#: Labelled rows to learn from, and features kept: what is collected is bounded by these.
SAMPLE = 12_000
FEATURES = 3_000
FOLDS = 5
PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
#: Sentences with a term of which counterfactuals are made, of each sampled row.
SENTENCES = 4
SENTENCE = re.compile(r"[.!?\n]+")
#: Terms that name groups of people, by language; a mention alone says nothing about toxicity.
IDENTITY = {
    "en": (
        "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "buddhist", "atheist", "catholic",
        "black", "white", "asian", "latino", "african", "european", "immigrant", "immigrants", "refugee", "refugees",
        "gay", "lesbian", "bisexual", "transgender", "queer", "straight", "woman", "women", "man", "men", "girl", "boy",
        "old", "young", "blind", "deaf", "disabled", "autistic", "mexican", "chinese", "german", "french", "spanish",
    ),
    "de": (
        "muslime", "christen", "juden", "buddhisten", "atheisten", "katholiken", "schwarze", "weiße", "asiaten", "afrikaner",
        "einwanderer", "flüchtlinge", "schwule", "lesben", "frauen", "männer", "mädchen", "jungen", "alte", "blinde", "behinderte", "türken",
    ),
    "fr": (
        "musulmans", "chrétiens", "juifs", "bouddhistes", "athées", "catholiques", "noirs", "blancs", "asiatiques", "africains",
        "immigrés", "réfugiés", "homosexuels", "lesbiennes", "femmes", "hommes", "filles", "garçons", "vieux", "aveugles", "handicapés", "arabes",
    ),
    "es": (
        "musulmanes", "cristianos", "judíos", "budistas", "ateos", "católicos", "negros", "blancos", "asiáticos", "africanos",
        "inmigrantes", "refugiados", "homosexuales", "lesbianas", "mujeres", "hombres", "chicas", "chicos", "viejos", "ciegos", "discapacitados", "gitanos",
    ),
}
TERMS = tuple(dict.fromkeys(t for terms in IDENTITY.values() for t in terms))
LANGUAGE = {t: terms for terms in IDENTITY.values() for t in terms}


def parts(word: str) -> tuple[str, ...]:
    """Features of a word: itself, and its beginnings, marked as such."""
    return (word, *[word[:k] + "*" for k in PREFIXES if len(word) > k])


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic: at most `size` labelled rows out of the held-out fold, one an id (of several texts the least)."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(size)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def _counted(rows: DataFrame) -> DataFrame:
    """feature, toxic, n: in how many rows of the sample each feature stands."""

    def run(batches):
        use_table("toxicity", lambda: None)
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(toxic > 0)].update({p for w in words(text or "") for p in parts(w)})
        for toxic, c in counts.items():
            if c:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c)), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["feature", "toxic", "n"]
                )

    small_batches(rows.sparkSession)
    return rows.select("text", "toxic").mapInArrow(run, "feature string, toxic int, n long")


def indexed(found: set[str], index: dict[str, int]) -> list[int]:
    """Numbers of the features of some words, in order."""
    return sorted({index[p] for w in found for p in parts(w) if p in index})


def counterfactuals(text: str, turn: int, index: dict[str, int]) -> list[tuple[list[int], list[int]]]:
    """Pairs of feature lists of sentences that differ in one identity term.

    In the first SENTENCES sentences that name a group, its term is swapped for another one of the same language, and left
    out; into the first sentence that names none, a term is put. turn says which term comes in.
    """
    out, plain, taken = [], None, 0
    for sentence in SENTENCE.split(text.lower()):
        found = set(WORD.findall(sentence))
        named = sorted(found.intersection(LANGUAGE))
        if named and taken < SENTENCES:
            taken += 1
            term = named[turn % len(named)]
            rest = found - {term}
            others = [t for t in LANGUAGE[term] if t not in found]
            own = indexed(found, index)
            out.append((own, indexed(rest, index)))
            if others:
                out.append((own, indexed(rest | {others[turn % len(others)]}, index)))
        elif found and plain is None and not named:
            plain = found
    if plain is not None:
        out.append((indexed(plain | {TERMS[turn % len(TERMS)]}, index), indexed(plain, index)))
    return out


def _rows(rows: DataFrame, index: dict[str, int]) -> list:
    """toxic, features, swaps of each row of the sample."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        use_table("toxicity", lambda: None)
        texts = [t or "" for t in batch.column(0).to_pylist()]
        found = [indexed(words(t), index) for t in texts]
        swaps = [[{"a": a, "b": b} for a, b in counterfactuals(t, crc32(t.encode()) % 7919, index)] for t in texts]
        lists = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, lists), pa.array(swaps, pa.list_(pa.struct([("a", lists), ("b", lists)])))], names=["toxic", "features", "swaps"])

    return map_text(rows, ["text", "toxic"], step, "toxic int, features array<int>, swaps array<struct<a: array<int>, b: array<int>>>", text=0).collect()  # SAMPLE rows


def flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Feature lists as the row and the feature of each entry."""
    where = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return where, np.concatenate([*[np.asarray(x, dtype=np.int64) for x in lists], np.empty(0, dtype=np.int64)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def loss(w: np.ndarray, b: float, data: tuple, y: np.ndarray, swaps: tuple[tuple, tuple], pairs: int, fairness: float, ridge: float) -> tuple[float, np.ndarray, float]:
    """Mean logistic loss + ridge / 2 * squared weights + fairness * mean squared score change over swaps; its gradient by weights and
    by bias."""

    def score(f: tuple, n: int) -> np.ndarray:
        return sigmoid(np.bincount(f[0], weights=w[f[1]], minlength=n) + b)

    def spread(f: tuple, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(f[1], weights=by_row[f[0]], minlength=len(w))

    p = score(data, len(y))
    error = (p - y) / len(y)
    value = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) + ridge / 2 * float(w @ w)
    g, gb = spread(data, error) + ridge * w, float(error.sum())
    if pairs:
        p, q = (score(f, pairs) for f in swaps)
        value += fairness * float(((p - q) ** 2).mean())
        change = 2 * fairness * (p - q) / pairs
        dp, dq = change * p * (1 - p), -change * q * (1 - q)
        g += spread(swaps[0], dp) + spread(swaps[1], dq)
        gb += float(dp.sum() + dq.sum())
    return value, g, gb


def minimise(rows: list, y: np.ndarray, swaps: list[tuple], size: int, fairness: float, ridge: float = 5e-5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of the least loss(), by Adam with a falling rate."""
    data, sides = flat(rows), (flat([a for a, _ in swaps]), flat([b for _, b in swaps]))
    share = y.mean()
    w, b = np.zeros(size), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        _, g, gb = loss(w, b, data, y, sides, len(swaps), fairness, ridge)
        rate = 0.2 * (1 - 0.9 * t / steps)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, features: int = FEATURES, fairness: float = 4.0) -> dict[str, float]:
    """Weight of each feature; "" has the bias. Empty if there is nothing to learn from."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(sample(docs, labels, size))  # the documents are read once for the fit
    totals = {int(r.toxic > 0): r["count"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    if len(totals) < 2:
        return {}
    one, none = (F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)) for k in (1, 0))
    p, q = one / totals[1], none / totals[0]
    mean = (one + none) / (totals[0] + totals[1])
    spread = F.sqrt(mean * (1 - mean) * (1 / totals[1] + 1 / totals[0])) + 1e-9
    best = (
        _counted(rows)
        .groupBy("feature")
        .agg(F.abs((p - q) / spread).alias("z"), F.sum("n").alias("n"))
        .where("n >= 3 and z > 3")
        .orderBy(F.desc("z"), "feature")
        .limit(features)
        .select("feature")
        .collect()  # FEATURES rows
    )
    index: dict[str, int] = {}
    for f in [*(r.feature for r in best), *TERMS]:
        index.setdefault(f, len(index))
    got = sorted((int(r.toxic > 0), tuple(r.features), tuple((tuple(p.a), tuple(p.b)) for p in r.swaps)) for r in _rows(rows, index))
    scratch.drop(rows)
    swaps = [p for _, _, pairs in got for p in pairs]
    w, b = minimise([f for _, f, _ in got], np.array([t for t, _, _ in got], dtype=np.float64), swaps, len(index), fairness)
    return {"": b} | {f: float(w[i]) for f, i in index.items()}


def text_score(text: str | None, weights: dict[str, float]) -> float:
    if not weights:
        return 0.0
    found: set[str] = set()
    for w in words(text) if text else ():
        for k in PREFIXES:
            if (p := w[:k] + "*") in weights and len(w) > k:
                found.add(p)
        if w in weights:
            found.add(w)
    z = weights[""] + sum(weights[p] for p in sorted(found))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def score(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # FEATURES numbers

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        use_table("toxicity", lambda: None)
        table = shared.value
        out = [text_score(t, table) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return map_text(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"], step, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def reject(docs: DataFrame, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below the threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # FEATURES numbers

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        use_table("toxicity", lambda: None)
        table = shared.value
        return batch.filter(pa.array([text_score(t, table) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    at = docs.columns.index("text")
    return map_text(docs, [F.col(f"`{c}`") for c in docs.columns], step, docs.schema, text=at)
