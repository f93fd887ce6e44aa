"""Kernels, rules, backtest and folds on small exact cases; causality and conservation properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels, special
from tidemark.operators import backtest, folds, inference, recursions, supervision
from tidemark.sources import files
from tidemark.streaming import paths


def series(spark, values, column="r", ticker="A"):
    days = pd.bdate_range("2024-01-01", periods=len(values)).date
    return spark.createDataFrame([(ticker, d, None if v is None else float(v)) for d, v in zip(days, values, strict=True)], f"ticker string, date date, {column} double")


def test_backtest_lag_cost_and_gaps(spark):
    r = series(spark, [0.01, 0.02, 0.03, 0.04, 0.05])
    got = backtest.run(r, series(spark, [1, 0, 0, 0, 0], "size"), 0).orderBy("date").collect()
    assert [round(x.gross, 9) for x in got] == [0, 0.02, 0, 0, 0]
    costs = backtest.run(r, series(spark, [1, -1, 1, -1, 1], "size"), 10, 0).orderBy("date").collect()
    assert [round(x.cost, 9) for x in costs] == [0.001, 0.002, 0.002, 0.002, 0.002]
    gap = backtest.run(r, series(spark, [1, 1, 1, 0, 0], "size").where("date <> '2024-01-02'"), 0).orderBy("date").collect()
    assert len(gap) == 4 and gap[1].w == 1  # the next decision row, across the gap
    null = backtest.run(series(spark, [0.1, None, 0.1]), series(spark, [1, 1, 1], "size"), 0).orderBy("date").collect()
    assert null[1].equity is None and round(null[2].equity, 9) == 1.1
    assert backtest.run(r.limit(0), r.withColumnRenamed("r", "size"), 1).count() == 0


def test_metrics_degenerate(spark):
    df = backtest.run(series(spark, [0.0, 0.0, 0.0]), series(spark, [1, 1, 1], "size"), 0)
    row = backtest.metrics(df).first()
    assert row.n == 3 and row.sharpe is None and row.profit_factor is None and row.hit_rate == 0 and row.max_drawdown == 0


def rules(spark, **values):
    base = {"size": 0.0, "calm": 0.5, "stress": 0.3, "crisis": 0.2, "sigma": 0.1, "psa": 0.0, "psa_severity": "none", "action": "long"}
    return supervision.detect(spark.createDataFrame(pd.DataFrame([base | values])))


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ({"size": -0.5, "calm": 0.9}, {"ram": 0.9, "ram_severity": "high", "ram_flag": True}),
        ({"size": 0.5, "crisis": 0.8}, {"ram": 0.8, "ram_severity": "high"}),
        ({"size": 0.0}, {"ram": 0.0, "ram_severity": "none", "gso_rel": 3.0}),
        ({"size": 0.5, "sigma": 0.1}, {"bound": 1.0, "bounded": 0.5, "gso_flag": False}),
        ({"size": 1.0, "sigma": 0.5}, {"bound": 0.2, "bounded": 0.2, "gso": 4.0, "gso_severity": "high"}),
        ({"size": 1.0, "sigma": 0.0}, {"bound": 1.0}),
        ({"size": 0.125, "sigma": 0.2}, {"convicted": 0.25}),
    ],
)
def test_detectors(spark, values, expected):
    row = rules(spark, **values).first().asDict()
    for k, v in expected.items():
        assert row[k] == pytest.approx(v) if isinstance(v, float) else row[k] == v


def test_interventions(spark):
    df = rules(spark, size=0.8, calm=0.1, crisis=0.3, sigma=0.1)
    final = lambda d, *a, **k: round(supervision.intervene(d, *a, **k).first().final_size, 9)
    assert final(df, "warn") == 0.8
    assert final(df, "reduce") == 0.6 and final(df, "reduce", reduce="continuous") == 0.56
    wrong = rules(spark, size=-0.8, calm=0.6, crisis=0.1, sigma=0.2, psa_severity="high")
    assert [final(wrong, "override", v) for v in "ABCD"] == [0, 0.075, 0.25, 0.4]
    assert supervision.intervene(wrong, "override", "A").first().final_action == "hold"
    for bad in (("shout",), ("override", "Z"), ("reduce", "C", "other")):
        with pytest.raises(ValueError):
            supervision.intervene(df, *bad)


def test_change_points():
    """A series whose deviation grows sevenfold: the run starts anew after the change, and values before it do not see it."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0.3, 0.05, 130), rng.normal(-0.2, 0.35, 90)])
    best, near = kernels.bocpd(x, 1 / 80)
    assert best[129] > 110 and best[160] < 45 and near[131:136].max() > 5 * near[60:130].mean()
    assert np.allclose(kernels.bocpd(x[:130], 1 / 80)[1], near[:130])
    with pytest.raises(ValueError):
        kernels.bocpd(np.zeros((3, 2)), 0.01)


def test_volatility_is_causal():
    r = np.random.default_rng(0).normal(0, 0.01, 100)
    other = r.copy()
    other[20] *= 5
    a, b = (kernels.garch_path(x, **recursions.GARCH) for x in (r, other))
    assert np.array_equal(a[:21], b[:21]) and a[21] != b[21]


def test_regime_filter():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal([0, s], [s, 0.05], (300, 2)) for s in (0.5, 1.0, 2.0)])
    m = kernels.hmm_fit(x, 3, range(3), 60)
    dens = kernels.log_gauss((x - m["centre"]) / m["spread"], m["means"], m["covs"])
    now, smooth = (f(dens, m["start"], m["trans"]) for f in (kernels.hmm_filter, kernels.hmm_smooth))
    assert np.allclose(now.sum(axis=1), 1) and np.allclose(now[-1], smooth[-1])
    assert np.allclose(kernels.hmm_filter(dens[:200], m["start"], m["trans"]), now[:200])
    path = kernels.viterbi(dens, m["start"], m["trans"])
    assert (path[:300] == 0).mean() > 0.7 and (path[-300:] == 2).mean() > 0.7
    assert len(kernels.viterbi(dens[:0], m["start"], m["trans"])) == 0


def test_folds(spark):
    days = pd.bdate_range("2020-01-01", periods=401).date
    events = spark.createDataFrame([(i, days[i], days[i + 1]) for i in range(400)], "row_pos long, t0 date, t1 date")
    got = folds.purged(events).toPandas()
    train = got[got.role == "train"].groupby("fold_id").size().reindex(range(15), fill_value=0).tolist()
    assert train == [262, 195, 129, 62, 0, 260, 194, 127, 65, 261, 194, 132, 261, 199, 265]
    both = got.groupby(["fold_id", "row_pos"]).size()
    assert both.max() == 1
    with pytest.raises(ValueError):
        folds.purged(events, 2, 2)


def test_tails():
    assert special.binomial_two_sided(2, 2) == 0.5 and special.binomial_two_sided(52, 124) == pytest.approx(0.087553, abs=1e-6)
    assert special.t_tail(2.0, 10) == pytest.approx(0.0366940, abs=1e-7) and special.t_tail(0, 5) == 0.5
    assert special.chi2_1_tail(3.841459) == pytest.approx(0.05, abs=1e-6)
    assert inference.mcnemar_p(0, 0) == 1 and inference.mcnemar_p(50, 71) == pytest.approx(0.069, abs=2e-3)
    low, high = inference.sign_interval(163, 400)
    assert low == pytest.approx(0.3589, abs=1e-3) and high == pytest.approx(0.4574, abs=1e-3)
    assert inference.tost_p(0, 0, 10, 1) == 0 and math.isnan(inference.deflated_sharpe(1, 5, 1))
    assert inference.information_criteria(-9286.92, 3, 2, 6204)[1] == pytest.approx(18774.7, abs=0.1)


def plain_resample(n, rng, p):
    """The draws one by one."""
    at, opens, firsts = int(rng.integers(0, n)), rng.random(n - 1), rng.integers(0, n, n - 1)
    out = [at]
    for u, f in zip(opens, firsts, strict=True):
        at = int(f) if u < p else (at + 1) % n
        out.append(at)
    return out


def test_resampling():
    for n in (2, 3, 50, 301):
        a, b = np.random.default_rng(n), np.random.default_rng(n)
        for _ in range(5):
            assert kernels.stationary_bootstrap(n, a, 4.0).tolist() == plain_resample(n, b, 1 / 4.0)
    x = np.random.default_rng(0).normal(0.1, 1, 200)
    point, low, high = inference.bootstrap(x, np.mean, 300)
    assert low < point < high and inference.bootstrap(x, np.mean, 300) == (point, low, high)
    assert math.isnan(inference.bootstrap(x[:1], np.mean, 10)[1])
    plain = np.random.default_rng(42)
    assert inference.replicates(x, np.mean, 3, 0.0, 42).tolist() == [x[plain.integers(0, 200, 200)].mean() for _ in range(3)]


def test_block_permutation():
    d = np.random.default_rng(3).normal(0.3, 1, 77)
    size, rng, hits = 9, np.random.default_rng(42), 0
    signs = rng.choice((-1.0, 1.0), size=(400, 9))
    for s in signs:
        flipped = d * np.repeat(s, size)[:77]
        hits += abs(flipped.mean()) >= abs(d.mean()) - 1e-12
    assert inference.block_permutation_p(d, 400) == hits / 400
    assert inference.block_permutation_p(np.full(64, 0.5), 4000) < 0.02 and math.isnan(inference.block_permutation_p(np.array([])))


def test_gate(spark):
    rng = np.random.default_rng(3)
    c = rng.uniform(0, 1, 1500)
    sure = rng.uniform(size=1500) < 1 / (1 + np.exp(-6 * (c - 0.55)))
    rising = inference.gate(c, sure, 60)
    assert rising["identified"] and 0.45 < rising["tau"] < 0.65 and rising["low"] < rising["tau"] < rising["high"] and rising["share"] == 1
    falling = inference.gate(c, 1.0 - sure, 20)
    assert not falling["identified"] and math.isnan(falling["tau"]) and falling["slope"] < 0
    assert not inference.gate(c, np.ones(1500), 5)["identified"]
    days = pd.DataFrame({"ticker": "A", "conf": c, "right": sure.astype(float)})
    got = inference.isotonic_gates(spark.createDataFrame(pd.concat([days, days.assign(ticker="B", conf=0.31)])), "ticker").toPandas().set_index("ticker").tau
    assert 0.4 < got["A"] < 0.7 and pd.isna(got["B"])  # one bin is too few


def test_isotonic_crossing():
    mids = np.array([0.05, 0.25, 0.55, 0.95])
    assert inference.isotonic_crossing(mids, np.array([0.2, 0.4, 0.6, 0.9]), np.ones(4)) == pytest.approx(0.4)
    assert inference.isotonic_crossing(mids, np.array([0.8, 0.2, 0.2, 0.9]), np.array([1.0, 1, 1, 1])) == pytest.approx(0.55 + 0.4 * 0.2, abs=0.003)
    assert math.isnan(inference.isotonic_crossing(mids, np.full(4, 0.4), np.ones(4))) and inference.isotonic_crossing(mids, np.full(4, 0.5), np.ones(4)) == 0


def test_diebold_mariano(spark):
    d = np.random.default_rng(4).normal(0.2, 1, 300)
    df = series(spark, d, "d").withColumnRenamed("ticker", "key")
    row = inference.diebold_mariano(df, 2).first()
    e = d - d.mean()
    assert row.dm == pytest.approx(d.mean() / math.sqrt((e.var() + 2 * (e[1:] * e[:-1]).mean()) / 300))
    assert inference.diebold_mariano(series(spark, [1, 1], "d").withColumnRenamed("ticker", "key")).first().p is None


def test_files(spark, tmp_path):
    persona = {"p": {"action": "long", "size": 0.1, "confidence": 0.5, "reasoning": "x"}}
    rows = [("2024-01-01", "A", "long", 0.1, 0.6, "r", persona), ("2024-01-02", "A", "hold", 0.0, 0.5, "r", None)]
    files.write_json(spark.createDataFrame(rows, files.DECISION), str(tmp_path / "json"))
    got = spark.read.schema(files.DECISION).json(str(tmp_path / "json"))
    assert got.count() == 2 and got.where("personalities['p'].size = 0.1").count() == 1
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text('{\n"date": "2024-01-03", "ticker": "B", "action": "short", "size": -0.1}')
    assert files.read_decisions(spark, str(tmp_path / "one")).first().date.isoformat() == "2024-01-03"
    assert len(files.folder_print(spark, str(tmp_path / "one")).first().fingerprint) == 16
    bars = spark.createDataFrame([("A", days, 1.0, 2.0, 0.5, float("nan"), None) for days in pd.bdate_range("2024-01-01", periods=2).date], files.BARS)
    files.write_parquet(bars, str(tmp_path / "bars"), "ticker")
    back = files.read_bars(spark, str(tmp_path / "bars")).first()
    assert back.Close is None and back.Volume == 0
    with pytest.raises(RuntimeError):
        files.write_parquet(bars.limit(0), str(tmp_path / "none"))
        files.read_bars(spark, str(tmp_path / "none"))
    assert spark.range(1).select(files.cache_name(F.lit("^A/B"), F.lit("s"), F.lit("e"))).first()[0] == "A_B_s_e.parquet"


def test_stream_equals_batch(spark, tmp_path):
    r = series(spark, np.random.default_rng(5).normal(0, 0.01, 40))
    rows = r.orderBy("date").collect()
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], r.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = paths.garch(stream).writeStream.format("memory").queryName("sigma_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {x.date: x.sigma for x in spark.sql("select * from sigma_stream").collect() if not x.late}
    whole = {x.date: x.sigma for x in recursions.garch(r).collect()}
    assert len(got) == 40 and all(got[d] == pytest.approx(whole[d], abs=1e-12) for d in whole)


def test_gate_and_meta_learner_cover_all_tickers(spark, sf):
    """Every ticker has a gate and a probability for each of its labelled days."""
    from tidemark.plans import experiments

    days = {r.ticker: r["count"] for r in experiments.supervised(spark, sf).where(experiments.VALID).groupBy("ticker").count().collect()}
    assert {r.ticker for r in experiments.c3_gate(spark, sf).collect()} == set(days) and len(days) == 5
    got = experiments.v6_meta_learner(spark, sf).collect()
    assert {t: sum(r.ticker == t for r in got) for t in days} == days and all(0 <= r.p <= 1 for r in got)


def test_regimes_do_not_see_later_rows(spark):
    rng = np.random.default_rng(6)
    rows = [("A", day.date(), float(r), float(v)) for day, r, v in zip(pd.bdate_range("2024-01-01", periods=120), rng.normal(0, 1, 120), rng.uniform(5, 30, 120), strict=True)]
    schema = "ticker string, date date, r double, rv double"
    other = [(*x[:2], x[2] * (9 if i >= 80 else 1), x[3] * (3 if i >= 80 else 1)) for i, x in enumerate(rows)]
    both = []
    for data in (rows, other):
        df = spark.createDataFrame(data, schema)
        a = {r.date: (r.calm, r.stress, r.crisis) for r in recursions.regimes(df).collect()}
        assert a == {r.date: (r.calm, r.stress, r.crisis) for r in recursions.regime_filter(df).collect()} == {r.date: (r.calm, r.stress, r.crisis) for r in recursions.market(df).collect()}
        both.append(a)
    days = [x[1] for x in rows]
    assert all(both[0][day] == both[1][day] for day in days[:80]) and any(both[0][day] != both[1][day] for day in days[80:])


def test_fitted_models(spark):
    """Two clear states are found again, in the order of volatility; the variance model's parameters come near; versions are kept."""
    from tidemark.operators import models

    rng = np.random.default_rng(8)
    wild = np.repeat([0, 1, 0, 1], 150)
    x = np.column_stack([rng.normal(0, np.where(wild, 2.0, 0.5)), rng.normal(np.where(wild, 9.0, 3.0), 0.8)])
    days = pd.bdate_range("2020-01-01", periods=600).date
    df = spark.createDataFrame([("A", d, float(a), float(b)) for d, (a, b) in zip(days, x, strict=True)], "ticker string, date date, r double, rv double")
    fitted = models.fit_regimes(df, (2, 3), tuple(range(4))).persist()
    two = models.model_of(fitted.where("k = 2").first().asDict())
    assert np.diag(two["trans"]).min() > 0.9 and two["means"][0, 1] < two["means"][1, 1]
    out = models.apply_regimes(df, fitted).toPandas()
    assert len(out) == 1200 and np.allclose(out[["calm", "stress", "crisis"]].sum(axis=1), 1) and (out[out.k == 2].stress == 0).all()
    assert (out[out.k == 2].sort_values("date").state.to_numpy() == wild).mean() > 0.97
    single = kernels.hmm_fits(x, 2, [2])[0]
    together = [m for m in kernels.hmm_fits(x, 2, [0, 2, 5]) if m["seed"] == 2][0]
    assert single["loglik"] == pytest.approx(together["loglik"]) and np.allclose(single["trans"], together["trans"])
    stay = models.transitions(fitted.where("k = 2")).orderBy("state").collect()
    assert [r.duration for r in stay] == pytest.approx([1 / (1 - v) for v in np.diag(two["trans"])])
    assert models.criteria(fitted).where("k = 2").first().free == 1 + 2 + 4 + 6
    held = {r.k: r.loglik for r in models.heldout_loglik(df, (2, 3), (0, 1)).collect()}
    assert held[2] > -4 and set(held) == {2, 3}
    r_next = df.withColumn("r_next", F.when(F.col("rv") < 6, 1.0).otherwise(-1.0))
    assert models.directional(r_next, (2,), (0, 1)).first().accuracy > 0.9


def test_variance_fit(spark, tmp_path):
    from tidemark.operators import models

    rng, var, shock, r = np.random.default_rng(5), 1.0, 0.0, []
    for _ in range(3000):
        var = 0.05 + 0.10 * shock**2 + 0.85 * var
        shock = math.sqrt(var) * rng.standard_t(8) * math.sqrt(6 / 8)
        r.append((shock + 0.02) / 100)
    df = series(spark, r)
    got = models.fit_volatility(df).persist()
    m = got.first()
    assert 0.06 < m.alpha < 0.16 and 0.75 < m.beta < 0.92 and m.alpha + m.beta < 1 and 4 < m.nu < 20
    whole = kernels.garch_path(np.array([*r, 0.01]), m.mu, m.omega, m.alpha, m.beta, (np.var(100 * np.array(r)) - m.omega) / (m.alpha + m.beta), math.sqrt((np.var(100 * np.array(r)) - m.omega) / (m.alpha + m.beta)))
    more = spark.createDataFrame([("A", pd.Timestamp("2040-01-02").date(), 0.01)], df.schema)
    assert models.apply_volatility(more, got).first().sigma == pytest.approx(whole[-1], rel=1e-6)
    path = str(tmp_path / "models")
    for version in (1, 2):
        models.write_version(got.withColumn("omega", F.col("omega") * version), path, version)
    assert models.read_version(spark, path).first().omega == pytest.approx(2 * m.omega) and models.read_version(spark, path, 1).first().omega == m.omega
    assert models.same_parameters(models.read_version(spark, path, 1), got).first().same and not models.same_parameters(models.read_version(spark, path), got).first().same


def test_choice_of_states(spark):
    from tidemark.operators import models

    rows = [("A", 2, 0.6, 0.5), ("A", 3, 0.6, 0.5), ("A", 4, 0.9, 0.01), ("B", 2, 0.4, 0.01), ("B", 3, 0.5, 0.02), ("C", 3, None, 0.9), ("C", 2, 0.1, 0.9)]
    df = spark.createDataFrame(rows, "ticker string, k int, v double, share double")
    assert {r.ticker: r.k for r in models.best_k(df, "v", share="share").collect()} == {"A": 2, "B": 3, "C": 2}


def test_thresholds_and_orders(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"psa": {"score_distribution": {"p50": 0.1, "p75": 0.2, "p90": 0.3, "p95": 0.4, "p99": 0.5, "max": 0.9}}, "ram": {"flag_percentile": 75, "score_distribution": {"p50": 0.1, "p75": 0.2, "p90": 0.3, "p95": 0.4, "p99": 0.15, "max": 0.9}}, "notes": "x"}')
    got = {r.detector: (r.low, r.medium, r.high) for r in files.read_thresholds(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"psa": (0.4, 0.5, 0.9), "ram": (0.2, 0.2, 0.2)}
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        files.read_thresholds(spark, str(tmp_path / "bad.json"))
    scores = spark.createDataFrame([("A", "psa", i / 100) for i in range(101)] + [("A", "ram", i / 100) for i in range(101)], "ticker string, detector string, score double")
    cut = supervision.uncalibrated(supervision.calibrated_cuts(scores)).first()
    assert [round(v, 9) for v in (cut.psa_low, cut.psa_medium, cut.psa_high, cut.ram_low, cut.ram_medium, cut.ram_high, cut.gso_low)] == [0.95, 0.99, 1, 0.75, 0.9, 0.99, 0.2]
    orders = [("buy", 10, 50.0, 1000.0, "long", 0.5), ("Short", 10, 50.0, 1000.0, "short", -0.5), ("cover", 99, 50.0, 100.0, "long", 1.0), ("sell", 0, 1.0, 1.0, "short", 0.0), ("hold", 5, 1.0, 9.0, "hold", 0.0), ("buy", 5, 1.0, 0.0, "long", 0.0), ("odd", 1, 1.0, 2.0, "hold", 0.5), (None, 1, 1.0, 2.0, "hold", 0.0), ("bearish", 1, 1.0, 2.0, "short", 0.5)]
    df = spark.createDataFrame(orders, "word string, q long, price double, cash double, action string, size double")
    for r in df.select("*", supervision.action_of(F.col("word")).alias("a"), supervision.size_of(F.col("word"), F.col("q"), F.col("price"), F.col("cash")).alias("s")).collect():
        assert (r.a, r.s) == (r.action, r["size"])
    levels = spark.range(3).select(supervision.default_severity(F.array(F.lit(-3.0), F.lit(0.45), F.lit(8.0))[F.col("id").cast("int")]).alias("x")).collect()
    assert [r.x for r in levels] == ["none", "medium", "high"]


def test_supervisor_options(spark):
    """Detectors that are off have no say, but the volatility check bounds sizes in override mode; the sizing check needs history."""
    base = spark.createDataFrame([(0.9, 0.1, 0.8, 0.5, "long", 0.95, True, 1)], "size double, calm double, crisis double, sigma double, action string, psa double, psa_ready boolean, map_run_length int")
    final = lambda **k: round(supervision.supervise(base, **({"mode": "override", "variant": "C"} | k)).first().final_size, 9)
    assert final() == -0.1 and final(enabled={"ram", "gso"}) == -0.2 and final(enabled={"psa"}) == 0.1 and final(enabled=set()) == 0.2
    assert final(mode="reduce", enabled=set()) == 0.9 and final(mode="reduce", reduce="ram_continuous", enabled={"psa"}) == 0.9
    assert final(enabled=set(), gso_mode="relative_conviction") == 0.2 and final(cuts={"ram": (0.3, 0.85, 0.9)}) == 0.1
    young = base.withColumn("psa_ready", F.lit(False))
    assert round(supervision.supervise(young, "override", "C").first().final_size, 9) == -0.2
    assert supervision.supervise(base, "warn", psa_signal="map_runlength").first().psa_severity == "high"
    for bad in ({"enabled": {"other"}}, {"gso_mode": "other"}):
        with pytest.raises(ValueError):
            supervision.supervise(base, **bad)
    jump = series(spark, [0.1] * 25 + [0.9] * 2, "size")
    rows = recursions.sizing_anomaly(jump, "size").orderBy("date").collect()
    assert [r.psa_ready for r in rows] == [False] * 6 + [True] * 21 and rows[0].psa == 0 and rows[-1].psa > 3 * rows[20].psa
    delta = recursions.sizing_anomaly(jump, "size", signal="cp_prob_delta").orderBy("date").collect()
    assert [r.psa_ready for r in delta].index(True) == 7


def test_stump_and_trees():
    from tidemark.functions.trees import Boosted, Logistic, stump

    x, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 0, 0, 1, 1, 0])
    best = min((sum(2 * s.sum() * (1 - s.mean()) for s in (y[x <= c], y[x > c])), c) for c in (1.5, 2.5, 3.5, 4.5, 5.5))
    cut, accuracy, under, over = stump(x, y)
    assert cut == best[1] == 3.5 and accuracy == pytest.approx(5 / 6) and (under, over) == (0.0, pytest.approx(2 / 3))
    assert math.isnan(stump(np.ones(4), np.array([0.0, 1, 1, 1]))[0]) and stump(np.ones(4), np.array([0.0, 1, 1, 1]))[1] == 0.75
    rng = np.random.default_rng(0)
    z = rng.normal(size=(600, 3))
    label = ((z[:, 0] > 0) ^ (z[:, 1] > 0.3)).astype(float)
    model = Boosted().fit(z[:400], label[:400])
    assert ((model.predict(z[400:]) > 0.5) == label[400:]).mean() > 0.9 and (Boosted().fit(z[:400], label[:400]).predict(z) == model.predict(z)).all()
    line = (z[:, 2] > 0.2).astype(float)
    assert ((Logistic().fit(z[:400], line[:400]).predict(z[400:]) > 0.5) == line[400:]).mean() > 0.95


def test_learning_on_folds(spark):
    """A label that one feature tells: found out of fold, that feature first; empty or one-sided training sets are skipped."""
    from tidemark.operators import learning

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(size=200)
    rows = spark.createDataFrame([("K", i, float(a[i] > 0), float(a[i]), float(b[i])) for i in range(200)], "key string, row_pos long, label double, a double, b double")
    cut = spark.createDataFrame([("K", f, i, "test" if i % 4 == f else "train") for f in range(4) for i in range(200)] + [("K", 9, 0, "test")], "key string, fold_id int, row_pos long, role string")
    got = learning.out_of_fold_by(rows, cut, ["a", "b"], "key").toPandas()
    assert len(got) == 200 and ((got.sort_values("row_pos").p.to_numpy() > 0.5) == (a > 0)).mean() > 0.95
    assert learning.importance_by(rows, cut, ["a", "b"], "key").where("place = 1").first().feature == "a"
    board = learning.leaderboard_by(rows, cut, ["a", "b"], "key")
    text = learning.leader_metadata(board, "key", spark.createDataFrame([("K", 150)], "key string, train_n long"), True).first().metadata
    record = learning.read_metadata(text)
    assert record["leaderboard"][0]["kind"] == record["leader_id"] and len(record["leaderboard"]) == 3 and record["train_n"] == 150


def test_cache_and_latest(spark, tmp_path):
    cache = files.AnswerCache(spark, str(tmp_path / "cache"))
    cache.update(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, answer string"))
    cache.update(spark.createDataFrame([("a", "3")], "key string, answer string"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r.key: r.answer for r in cache.lookup(asked).collect()} == {"a": "3", "b": "2", "c": None}
    cache.clear()
    assert cache.lookup(asked).where("answer is not null").count() == 0
    (tmp_path / "f").mkdir()
    for name, data in (("x_2020.bin", b"one"), ("x_2021.bin", b"two")):
        (tmp_path / "f" / name).write_bytes(data)
    assert files.latest(spark, str(tmp_path / "f" / "x_*.bin")).endswith("x_2021.bin")
    import hashlib

    assert files.folder_print(spark, str(tmp_path / "f")).first().fingerprint == hashlib.sha256(b"x_2020.binonex_2021.bintwo").hexdigest()[:16]
    made = []
    for _ in range(2):
        files.read_through(spark, str(tmp_path / "kept"), lambda: made.append(1) or spark.range(3)).count()
    assert made == [1]
    with pytest.raises(RuntimeError):
        files.read_through(spark, str(tmp_path / "nothing"), lambda: spark.range(0))
    one, two = (spark.createDataFrame([(day, v) for day, v in rows], "date int, Close double") for rows in ([(1, 1.0), (2, float("nan")), (3, 3.0)], [(1, 5.0), (2, 6.0), (4, 7.0)]))
    assert [tuple(r) for r in files.aligned(one, two, ("a", "b")).collect()] == [(1, 1.0, 5.0)]


def test_profit_factor_and_text(spark):
    from tidemark.functions import text

    gains = backtest.run(series(spark, [0.1, 0.2, 0.1]), series(spark, [1, 1, 1], "size"), 0)
    assert backtest.metrics(gains).first().profit_factor == math.inf
    df = spark.createDataFrame([(0.0123, 1.5), (-0.5, None), (float("nan"), float("inf"))], "a double, b double")
    assert [tuple(r) for r in df.select(text.percent(F.col("a")), text.number(F.col("b"))).collect()] == [("+1.23%", "1.50"), ("-50.00%", "n/a"), ("n/a", "n/a")]
    said = df.limit(1).select(text.statistics_text(*[F.lit(v) for v in (0.5, 0.3, 0.2)], F.lit("calm"), F.lit(0.2), F.lit(0.5), F.lit(-1))).first()[0]
    assert "calm 0.50, stress 0.30, crisis 0.20 (most likely path: calm)" in said and said.endswith("negative in calm and positive in crisis.")


def test_sensitivity_against_plain(spark, sf):
    """One point of the sweep recomputed row by row."""
    from tidemark.plans import experiments

    rows = experiments.sweep(spark, sf).where("moved = 'gso' and percent = 50").toPandas()
    assert len(rows) and (rows.gso_low == rows.gso_medium).all()
    for r in rows.itertuples():
        size = r.size if r.gso < max(r.gso_medium, r.gso_low) else np.sign(r.size) * min(abs(r.size), r.bound)
        if r.ram >= 0.5:
            size = (1 if r.calm >= r.crisis else -1) * r.bound
        if r.psa_ready and r.psa >= r.psa_high:
            size *= 0.5
        assert r.final_size == pytest.approx(size)
    got = experiments.performance(experiments.sweep(spark, sf).withColumn("w", F.col("final_size")), "moved", "percent").where("moved = 'gso' and percent = 50").toPandas().set_index("ticker")
    for ticker, g in rows.sort_values("date").groupby("ticker"):
        w = np.concatenate([[0.0], g.final_size.to_numpy()[:-1]])
        net = w * g.r.to_numpy() - 1e-4 * np.abs(np.diff(w, prepend=0.0))
        assert got.sharpe[ticker] == pytest.approx(net.mean() / net.std(ddof=1) * math.sqrt(252))
