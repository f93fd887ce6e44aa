"""Long series in blocks, change points without impossible runs, replicates over tasks, Shapley values."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.functions.trees import Boosted, Logistic
from tidemark.operators import inference, recursions, scans


def series(spark, sizes, seed=1):
    rng, rows = np.random.default_rng(seed), []
    for t, n in sizes.items():
        r = rng.normal(size=n) * 0.01 * np.where(np.arange(n) // 97 % 2, 3, 1)
        rows.append(pd.DataFrame({"ticker": t, "date": pd.date_range("2000-01-01", periods=n).date, "r": r, "rv": np.abs(r) * 900 + 5 + rng.normal(size=n)}))
    return spark.createDataFrame(pd.concat(rows).sample(frac=1, random_state=3), "ticker string, date date, r double, rv double").repartition(5)


def same(left, right, columns):
    both = left.alias("a").join(right.alias("b"), ["ticker", "date"])
    gaps = both.agg(F.count("*"), *[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))) for c in columns], *[F.count_if(F.col(f"a.{c}").isNull() != F.col(f"b.{c}").isNull()) for c in columns]).first()
    assert gaps[0] == left.count() == right.count()
    assert max(gaps[1 : 1 + len(columns)]) < 1e-9 and not any(gaps[1 + len(columns) :])


def test_blocks_equal_whole_series(spark):
    df = series(spark, {"a": 3000, "b": 1, "c": 40, "d": 700}).cache()
    for tasks in (None, 1, 9):
        same(scans.garch(df.select("ticker", "date", "r"), tasks=tasks), recursions.garch(df.select("ticker", "date", "r")), ["sigma"])
        same(scans.regime_filter(df, tasks=tasks), recursions.regime_filter(df), ["calm", "stress", "crisis"])
    assert scans.garch(df.where("ticker = 'none'").select("ticker", "date", "r")).count() == 0


def test_a_series_lies_in_many_tasks(spark):
    df = series(spark, {"a": 3000, "b": 20}).select("ticker", "date", "r")
    rows = scans._ranges(df, lambda part, state: ({"x": part["r"]}, ()), "x double", 8)
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy("ticker").agg(F.countDistinct("block"), F.max("k")).collect()}
    assert counts["a"][0] >= 7 and counts["a"][1] < 800
    plan = scans.garch(df, tasks=8)._jdf.queryExecution().executedPlan().toString()
    grouped = plan[plan.index("FlatMapGroupsInPandas") :]
    assert plan.count("FlatMapGroupsInPandas") == 1 and "max_by" in grouped  # it gets a row a block


def test_far_states_stay_apart(spark):
    """Densities that differ by thousands, and transitions that cannot happen."""
    df = series(spark, {"a": 400}).withColumn("rv", F.when(F.dayofyear("date") % 50 == 0, 5000.0).otherwise(F.col("rv")))
    hard = recursions.HMM | {"trans": np.array([[0.9, 0.1, 0.0], [0.0, 0.9, 0.1], [0.1, 0.0, 0.9]]), "start": np.array([1.0, 0.0, 0.0])}
    same(scans.regime_filter(df, hard, 6), recursions.regime_filter(df, hard), ["calm", "stress", "crisis"])


def shifting(n, every, seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(size=n // every + 1) * 4, every)[:n] + rng.normal(size=n) * noise


@pytest.mark.parametrize("x", [
    shifting(3000, 250), shifting(2000, 40, 1), np.random.default_rng(2).uniform(-0.25, 0.25, 1500), np.zeros(800),
    np.r_[np.full(600, 0.2), np.full(300, -0.2), np.full(600, 0.2)], np.r_[shifting(700, 700, 3), [1e4], shifting(700, 700, 3)],
], ids=["shifts", "often", "noise", "constant", "returning", "outlier"])
def test_pruned_change_points(x):
    best, near = kernels.bocpd(x, 1 / 250)
    for drop in (0.0, 1e-20):
        got, close, lost, held = kernels.bocpd_pruned(x, 1 / 250, drop=drop)
        assert np.abs(close - near).max() < 1e-9 and (got == best).all()
        assert (np.diff(lost) >= 0).all() and lost[-1] <= drop * held.sum()
        assert drop or (held == np.arange(len(x)) + 2).all()


def test_pruned_change_points_grow_with_rows():
    held = [kernels.bocpd_pruned(shifting(n, 100), 1 / 100)[3] for n in (5_000, 20_000)]
    assert max(h.max() for h in held) < 1200
    assert held[1].sum() < 5 * held[0].sum()


def test_pruned_by_ticker(spark):
    df = series(spark, {"a": 500, "b": 30}).withColumn("size", F.when(F.col("r") > 0, F.col("r") * 30))
    same(recursions.change_points_pruned(df, "size"), recursions.change_points(df, "size"), ["cp_prob", "map_run_length"])


def days(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"key": "k", "date": pd.date_range("2001-01-01", periods=n).date, "a": rng.normal(size=n) + 0.1, "b": rng.normal(size=n), "conf": rng.random(n)})
    x["right"] = (rng.random(n) < x["conf"]).astype(float)
    return x, spark.createDataFrame(pd.concat([x, x.assign(key="one").iloc[:1]]))


def test_replicates_do_not_depend_on_how_they_are_dealt(spark):
    x, df = days(spark)
    draws = {"mean": inference.resampled(np.mean, "a"), "plain": inference.resampled(np.mean, "a", block=0.0), "gap": inference.resampled(inference.sharpe_difference, "a", "b"), "flip": inference.flipped("b")}
    dealt = [sorted(map(tuple, inference.replicated(df, "key", draws, 60, per).collect()), key=str) for per in (60, 7, 1)]
    assert dealt[0] == dealt[1] == dealt[2]
    a = x["a"].to_numpy()
    want = [a[kernels.stationary_bootstrap(len(a), kernels.generator(42, i), kernels.mean_block(len(a)))].mean() for i in range(60)]
    got = {(r[1], r[2]): r[3] for r in dealt[0] if r[0] == "k"}
    assert [got["mean", i] for i in range(60)] == want and got["mean", -1] == a.mean()
    spans = {(r.key, r.name): r for r in inference.intervals(inference.replicated(df, "key", draws, 60, 7), "key").collect()}
    r = spans["k", "mean"]
    assert r.n == 60 and (r.low, r.high) == pytest.approx(tuple(np.quantile(want, [0.025, 0.975])))
    assert spans["one", "mean"].low is None and spans["one", "mean"].point == a[0]
    assert abs(spans["k", "flip"]["mean"] - inference.block_permutation_p(x["b"].to_numpy())) < 0.2


def test_a_thousand_replicates_of_one_key_lie_in_many_tasks(spark):
    _, df = days(spark, 60)
    got = inference.replicated(df.where("key = 'k'"), "key", {"mean": inference.resampled(np.mean, "a")}, 1000, 50).where("replicate >= 0").withColumn("task", F.spark_partition_id())
    assert got.select("replicate").distinct().count() == 1000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got.select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_gates_by_replicates(spark):
    x, df = days(spark, 500)
    got = {r.key: r for r in inference.gates(df, "key", 80, 9).collect()}
    assert got == {r.key: r for r in inference.gates(df, "key", 80, 80).collect()}
    c, y, n = x["conf"].to_numpy(), x["right"].to_numpy(), len(x)
    index = np.stack([kernels.stationary_bootstrap(n, kernels.generator(42, i), kernels.mean_block(n)) for i in range(80)])
    taus = inference.crossings(c[index], y[index])[0]
    assert got["k"].identified and got["k"].tau == pytest.approx(np.nanmedian(taus)) and got["k"].share == np.isfinite(taus).mean()
    assert not got["one"].identified and got["one"].tau is None


def expected(model, t, binned, known, node=0, level=0):
    if level == model.depth:
        return model.leaf[t, node]
    here = 2**level - 1 + node
    f = model.feature[t, here]
    left, right = (lambda: expected(model, t, binned, known, 2 * node, level + 1)), (lambda: expected(model, t, binned, known, 2 * node + 1, level + 1))
    if f < 0:
        return left()
    if f in known:
        return right() if binned[f] > model.cut[t, here] else left()
    w = model.cover[t, 2 ** (level + 1) - 1 + 2 * node : 2 ** (level + 1) + 1 + 2 * node]
    return (w[0] * left() + w[1] * right()) / w.sum()


def test_shapley_values():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 5)), 1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=300) > 0).astype(float)
    model = Boosted(trees=8, depth=4).fit(x, y)
    base, shap = model.attributions(x)
    assert np.abs(base + shap.sum(axis=1) - model.margin(x)).max() < 1e-9
    binned, every = model._binned(x), range(5)
    for row in (0, 7, 33):
        value = lambda s: sum(expected(model, t, binned[row], s) for t in range(model.trees))  # noqa: E731, B023
        assert abs(value(set()) - base) < 1e-9
        for f in every:
            others = [g for g in every if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(4 - len(s)) / math.factorial(5) * (value({*s, f}) - value(set(s))) for k in range(5) for s in combinations(others, k))
            assert abs(shap[row, f] - want) < 1e-9
    line = Logistic().fit(x, y)
    base, shap = line.attributions(x)
    assert np.abs(1 / (1 + np.exp(-(base + shap.sum(axis=1)))) - line.predict(x)).max() < 1e-9


def test_spread_out_starts():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(150, 2)) * s + m for s, m in ((0.5, 0), (1.5, 4), (0.7, -6))])
    spread, drawn = (max(m["loglik"] for m in kernels.hmm_fits(x, 3, list(range(5)), spread_out=s)) for s in (True, False))
    assert spread >= drawn - 1e-2
    assert kernels.spread_means(np.ones((4, 2)), 3, 0).tolist() == [[1, 1]] * 3
