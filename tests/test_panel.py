"""Percentiles by counting, stacked series, published versions, searches and boards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, inference, learning, models, scans, selection
from tidemark.plans import experiments


def test_percentiles_by_counts(spark):
    rng = np.random.default_rng(0)
    odd = [0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, float("inf"), float("-inf")]
    rows = [("a", float(v)) for v in np.round(rng.normal(size=500), 1)] + [("b", v) for v in odd] + [("c", 2.5)] + [("d", None), ("e", 7.0), ("e", None), (None, 3.0), (None, 4.0)]
    rows += [("hot", 1.25)] * 2000 + [("hot", 9.0)]
    df = spark.createDataFrame(rows, "key string, x double").repartition(4)
    shares = (0.0, 0.05, 0.5, 0.75, 0.999, 1.0)
    got = {(r.key, r.share): r.value for r in selection.percentiles(df.where("key is not null"), "x", shares, "key").collect()}
    want = df.where("key is not null").groupBy("key").agg(*[F.percentile("x", F.lit(s)).alias(str(i)) for i, s in enumerate(shares)]).collect()
    for r in want:
        for i, s in enumerate(shares):
            value = r[str(i)]
            if value is None:
                assert (r.key, s) not in got
            elif not math.isnan(value):
                assert got[r.key, s] == pytest.approx(value, rel=1e-12, abs=1e-300), (r.key, s)
    whole = selection.percentiles(df, "x", [0.5]).collect()
    assert len(whole) == 1 and whole[0].n == df.where("x is not null").count() and whole[0].value == 1.25
    assert selection.percentiles(df.limit(0), "x", [0.5], "key").count() == 0


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e308, -2.0, -1e-320, 0.0, 1e-320, 3.0, np.inf, np.nan])
    import pandas as pd

    code = selection.ordered_bits.func(pd.Series(x)).to_numpy().view(np.uint64)
    assert (np.diff(code.astype(object)) > 0).all()
    back = selection.from_bits.func(pd.Series(code.view(np.int64))).to_numpy()
    assert np.array_equal(back, x, equal_nan=True)


def test_stacked_series_are_paired_by_place(spark):
    rng = np.random.default_rng(1)
    make = lambda sizes: spark.createDataFrame([(t, f"2001-{1 + i // 28:02}-{1 + i % 28:02}", float(v)) for t, n in sizes for i, v in enumerate(rng.normal(size=n))], "ticker string, date string, net double").withColumn("date", F.to_date("date"))
    left, right = make([("a", 150), ("b", 90), ("c", 1)]).repartition(3), make([("a", 140), ("b", 95), ("d", 70)]).repartition(5)
    series = [[r.net for r in df.orderBy("ticker", "date").collect()] for df in (left, right)]
    for tasks in (1, 6):
        assert [r.at for r in scans.numbered(left, "ticker", "date", tasks=tasks).orderBy("ticker", "date").collect()] == list(range(241))
    got = inference.diebold_mariano(experiments.stacked(left, right)).first()
    n = min(map(len, series))
    d = np.array(series[1][:n]) - np.array(series[0][:n])
    assert got.n == n and got.dm == pytest.approx(d.mean() / math.sqrt(d.var() / n))


def test_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(ValueError):
        models.published(spark, path)
    first, second = (spark.createDataFrame([("a", x)], "ticker string, mu double") for x in (1.0, 2.0))
    assert models.publish(first, path) == 1 and models.published(spark, path).first().mu == 1.0
    second.write.parquet(f"{path}/tables/crashed")  # a writer that died before its entry
    assert models.published(spark, path).first().mu == 1.0
    (tmp_path / "m" / "log" / "000000000002").write_text("tables/cra")  # or while it wrote it
    assert models.published(spark, path).first().mu == 1.0
    (tmp_path / "m" / "log" / "000000000002").unlink()
    for stale in (tmp_path / "m" / "log").glob(".*.crc"):
        stale.unlink()
    assert models.publish(second, path) == 2
    assert models.published(spark, path).first().mu == 2.0 and models.published(spark, path, 1).first().mu == 1.0
    with pytest.raises(ValueError):
        models.published(spark, path, 9)


def table(spark, n=120, keys=("a", "b")):
    rng, rows = np.random.default_rng(3), []
    for k in keys:
        walk = np.cumsum(rng.normal(size=n))
        for i in range(n):
            rows.append((k, i, f"2001-{1 + i // 28:02}-{1 + i % 28:02}", float(walk[i]), float(rng.normal()), float(walk[i] > np.median(walk))))
    return spark.createDataFrame(rows, "key string, row_pos long, day string, x double, z double, label double").withColumn("date", F.to_date("day"))


def test_shuffled_folds(spark):
    dealt = folds.shuffled(table(spark).select("key", "date"), "key", "date", 5).collect()
    for k in ("a", "b"):
        own = sorted((r.row_pos, r.fold) for r in dealt if r.key == k)
        assert [p for p, _ in own] == list(range(120)) and np.bincount([f for _, f in own]).tolist() == [24] * 5
        assert sum(a[1] == b[1] for a, b in zip(own, own[1:], strict=False)) < 60


def test_boards_and_search(spark):
    rows = table(spark)
    cut = folds.roles(folds.contiguous(rows.select("key", "date"), "key", "date", 5, 2), "key", 5)
    got = learning.fold_predictions(rows, cut, ["x", "z"], "key", ("logistic",)).toPandas()
    board = {(r.key, r.kind): r for r in learning.leaderboard_by(rows, cut, ["x", "z"], "key").collect()}
    for k, own in got.groupby("key"):
        ones, rest = own[own.y == 1].p.to_numpy(), own[own.y == 0].p.to_numpy()
        area = np.mean((ones[:, None] > rest) + 0.5 * (ones[:, None] == rest))
        assert board[k, "logistic"].auc == pytest.approx(area)
    kinds = ("line_0.01", "line_1.0", "line_100.0", "trees_40_2_0.05", "trees_40_2_0.2")
    found = learning.search_by(rows, cut, ["x", "z"], "key", 40, kinds).collect()
    assert len(found) == 10 and {r.place for r in found} == set(range(1, 6))
    for k in ("a", "b"):
        own = sorted((r for r in found if r.key == k), key=lambda r: r.place)
        assert [r.rung for r in own] == [3, 2, 1, 0, 0] and own[0].fits == 5 + 3 + 2 + 1
    assert {r.rung for r in learning.search_by(rows, cut, ["x", "z"], "key", 7, kinds).collect()} == {0}
