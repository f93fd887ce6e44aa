"""Cross-validation folds: combinatorial, purged and embargoed."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_table(df: DataFrame, k: int, m: int) -> DataFrame:
    """fold_id, group_id: every choice of m test groups among k, in lexicographic order."""
    rows = [(i, g) for i, c in enumerate(combinations(range(k), m)) for g in c]
    return df.sparkSession.createDataFrame(rows, "fold_id int, group_id int")


def purged(events: DataFrame, k: int = 6, m: int = 2, embargo: int = 5) -> DataFrame:
    """fold_id, row_pos, role of events (row_pos from 0, t0, t1).

    Groups cut the rows evenly. Each fold has one envelope, from its first test start to its last test end; rows whose
    [t0, t1] meets it, and `embargo` rows after each test group, are in no training set.
    """
    if not 0 < m < k:
        raise ValueError("m must be between 0 and k")
    n = events.count()
    starts = [int(n * i / k) for i in range(k + 1)]
    group = F.lit(0)
    for i in range(1, k):
        group = F.when(F.col("row_pos") >= starts[i], i).otherwise(group)
    rows = events.withColumn("group_id", group)
    folds = fold_table(events, k, m)
    tests = rows.join(F.broadcast(folds), "group_id").select("fold_id", "row_pos")
    bounds = rows.join(F.broadcast(folds), "group_id").groupBy("fold_id").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
    held = folds.groupBy("fold_id").agg(F.collect_list("group_id").alias("groups"))  # m numbers a fold
    spans = bounds.join(held, "fold_id")
    ends = F.array(*[F.lit(starts[i + 1]) for i in range(k)])
    after = F.exists("groups", lambda g: F.col("row_pos").between(F.element_at(ends, g + 1), F.element_at(ends, g + 1) + embargo - 1))
    overlaps = (F.col("t1") >= F.col("lo")) & (F.col("t0") <= F.col("hi"))
    train = rows.join(F.broadcast(spans), ~(overlaps | F.array_contains("groups", F.col("group_id")) | after))  # folds are few
    return tests.withColumn("role", F.lit("test")).union(train.select("fold_id", "row_pos").withColumn("role", F.lit("train")))


def purged_by(events: DataFrame, key: str, k: int = 6, m: int = 2, embargo: int = 5) -> DataFrame:
    """key, fold_id, row_pos, role: the folds of purged() for the events of each key, whose row_pos starts from 0."""
    if not 0 < m < k:
        raise ValueError("m must be between 0 and k")
    sizes = events.groupBy(key).agg(F.count("*").alias("n"))
    ends = F.array(*[F.floor(F.col("n") * i / F.lit(k)).cast("int") for i in range(1, k + 1)])
    rows = events.join(sizes, key).withColumn("ends", ends)
    rows = rows.withColumn("group_id", F.size(F.filter(F.slice("ends", 1, k - 1), lambda e: e <= F.col("row_pos"))))
    folds = fold_table(events, k, m)
    tests = rows.join(F.broadcast(folds), "group_id")
    bounds = tests.groupBy(key, "fold_id").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
    held = folds.groupBy("fold_id").agg(F.collect_list("group_id").alias("groups"))  # m numbers a fold
    after = F.exists("groups", lambda g: F.col("row_pos").between(F.get("ends", g), F.get("ends", g) + embargo - 1))
    overlaps = (F.col("t1") >= F.col("lo")) & (F.col("t0") <= F.col("hi"))
    train = rows.join(bounds.join(F.broadcast(held), "fold_id"), key).where(~(overlaps | F.array_contains("groups", F.col("group_id")) | after))
    return tests.select(key, "fold_id", "row_pos", F.lit("test").alias("role")).union(train.select(key, "fold_id", "row_pos", F.lit("train")))


def contiguous(df: DataFrame, key: str, order: str, k: int = 5, embargo: int = 5) -> DataFrame:
    """df with row_pos (from 0, by key) and fold: k stretches of each key's rows, fold f beginning at row floor(f * n / k). The last
    `embargo` rows of each stretch but the last are dropped."""
    if k < 2:
        raise ValueError("k must be 2 at least")
    out = df.withColumns({"row_pos": (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("long"), "n": F.count("*").over(W.partitionBy(key))})
    ends = F.array(*[F.floor(F.col("n") * F.lit(f) / F.lit(k)) for f in range(1, k)])
    out = out.withColumn("fold", F.size(F.filter(ends, lambda e: e <= F.col("row_pos"))))
    stop = F.floor((F.col("fold") + 1) * F.col("n") / F.lit(k))
    return out.where((F.col("fold") == k - 1) | (F.col("row_pos") < stop - embargo)).drop("n")


def shuffled(df: DataFrame, key: str, order: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with row_pos (from 0, by key) and fold: k folds of each key's rows dealt without regard to time, sizes one apart at most. Its
    scores are biased where neighbouring rows are alike."""
    out = df.withColumn("row_pos", (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("long"))
    dealt = F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), "row_pos"), "row_pos")) - 1
    return out.withColumn("fold", (dealt % k).cast("int"))


def roles(dealt: DataFrame, key: str, k: int) -> DataFrame:
    """key, fold_id, row_pos, role of rows dealt to folds 0 to k - 1: each fold is tested once, by what the others train."""
    test = dealt.select(key, F.col("fold").cast("int").alias("fold_id"), "row_pos", F.lit("test").alias("role"))
    train = dealt.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("fold_id <> fold").select(key, "fold_id", "row_pos", F.lit("train").alias("role"))
    return test.unionByName(train)
