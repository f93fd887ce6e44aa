"""Shared tables, decoded states, and the comparisons of learners against plain recomputation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import learning, recursions
from tidemark.plans import comparison, experiments
from tidemark.sources.scratch import once


def test_once_is_made_again_when_its_source_changes(spark, tmp_path):
    source, made = str(tmp_path / "s"), []
    spark.range(3).write.parquet(source)

    def make():
        made.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("x"))

    get = lambda name: sorted(r.x for r in once(spark, name, source, make).collect())
    assert get("a") == get("a") == [0, 2, 4] and len(made) == 1
    assert get("b") == [0, 2, 4] and len(made) == 2
    spark.range(3, 4).write.mode("append").parquet(source)
    assert get("a") == get("a") == [0, 2, 4, 6] and len(made) == 3


def test_once_keeps_nothing_of_a_failure_and_takes_empty_tables(spark, tmp_path):
    source = str(tmp_path / "s")
    spark.range(2).write.parquet(source)
    with pytest.raises(ZeroDivisionError):
        once(spark, "c", source, lambda: 1 / 0)
    assert once(spark, "c", source, lambda: spark.range(0)).count() == 0


def test_state_of_the_path_so_far_is_the_end_of_the_path_over_the_rows_so_far():
    rng = np.random.default_rng(0)
    dens = rng.normal(size=(60, 3)) * 2
    start, trans = recursions.HMM["start"], recursions.HMM["trans"]
    ends = kernels.viterbi_ends(dens, start, trans)
    assert [kernels.viterbi(dens[: t + 1], start, trans)[-1] for t in range(60)] == ends.tolist()
    assert len(set(ends.tolist())) > 1 and len(kernels.viterbi_ends(dens[:0], start, trans)) == 0


def test_decoded_so_far_does_not_look_ahead(spark):
    rng = np.random.default_rng(1)
    rows = [("a", (pd.Timestamp("2001-01-01") + pd.Timedelta(days=i)).date(), float(r), float(v)) for i, (r, v) in enumerate(zip(rng.normal(size=80), rng.uniform(5, 40, size=80), strict=True))]
    df = spark.createDataFrame(rows, "ticker string, date date, r double, rv double")
    whole = [r.state for r in recursions.decoded_so_far(df).orderBy("date").collect()]
    part = [r.state for r in recursions.decoded_so_far(df.where("date < '2001-02-10'")).orderBy("date").collect()]
    assert whole[: len(part)] == part and len(part) == 40


def test_fold_losses(spark):
    rows = [("a", 0, 0.8, 1.0), ("a", 0, 0.4, 0.0), ("a", 1, 1.0, 0.0), ("b", 0, 0.5, 1.0)]
    got = {r.key: r for r in learning.fold_losses(spark.createDataFrame(rows, "key string, fold_id int, p double, y double"), "key").collect()}
    one, two = -(np.log(0.8) + np.log(0.6)) / 2, -np.log(1e-15)
    assert got["a"].folds == 2 and got["a"].mean_loss == pytest.approx((one + two) / 2, rel=1e-2) and got["a"].most_loss == pytest.approx(two, rel=1e-2)
    assert got["a"].median_loss == pytest.approx((one + two) / 2, rel=1e-2) and got["b"].mean_loss == pytest.approx(np.log(2))


def test_learner_quality_and_position(spark, sf):
    p = experiments.v6_meta_learner(spark, sf).toPandas()
    rows = experiments.meta_rows(spark, sf).toPandas().merge(p, on=["ticker", "row_pos"])
    for r in comparison.i9_learner_quality(spark, sf).collect():
        d = rows[rows.ticker == r.ticker]
        up, rose = d.p >= 0.5, d.label == 1
        assert (r.tp, r.fp, r.fn, r.tn) == ((up & rose).sum(), (up & ~rose).sum(), (~up & rose).sum(), (~up & ~rose).sum())
        q = np.clip(d.p, 1e-15, 1 - 1e-15)
        assert r.log_loss == pytest.approx(-np.where(rose, np.log(q), np.log(1 - q)).mean()) and r.brier == pytest.approx(((d.p - d.label) ** 2).mean())
        pairs = d.p[rose].to_numpy()[:, None] - d.p[~rose].to_numpy()
        assert r.auc == pytest.approx((pairs > 0).mean() + (pairs == 0).mean() / 2)
    ten = comparison.ten(spark, sf).where("strategy in ('learner', 'override')").toPandas()
    mine = ten[ten.strategy == "learner"].merge(rows[["ticker", "date", "position"]], on=["ticker", "date"], how="left")
    assert (mine.w == mine.position.fillna(0.0)).all()
    final = experiments.supervised(spark, sf).select("ticker", "date", "final_size").toPandas().merge(ten[ten.strategy == "override"], on=["ticker", "date"])
    assert len(final) and np.allclose(final.w, final.final_size)


def test_leaders_are_fitted_on_calibration_days_alone(spark, sf):
    boards = comparison.boards(spark, sf).toPandas()
    assert set(boards.scheme) == {"shuffled", "purged"} and (boards.groupby(["scheme", "ticker"]).kind.nunique() == len(comparison.KINDS)).all()
    first = boards[boards.place == 1].set_index(["scheme", "ticker"])
    assert (first.auc >= boards.groupby(["scheme", "ticker"]).auc.max() - 1e-12).all()
    got = comparison.leaders(spark, sf).toPandas()
    rows = experiments.meta_rows(spark, sf).toPandas().sort_values(["ticker", "row_pos"])
    end = pd.Timestamp(experiments.CALIBRATION_END).date()
    for (scheme, ticker), d in list(got.groupby(["scheme", "ticker"]))[:3]:
        mine = rows[rows.ticker == ticker]
        train, test = mine[mine.date <= end], mine[mine.date > end]
        model = (learning.CANDIDATES | learning.GRID)[first.loc[(scheme, ticker)].kind]().fit(train[experiments.INPUTS].fillna(0.0).to_numpy(dtype=float), train.label.to_numpy())
        assert np.allclose(d.sort_values("date").p, model.predict(test[experiments.INPUTS].fillna(0.0).to_numpy(dtype=float)))


def test_sizing_cells_and_their_differences(spark, sf):
    cells = comparison.cells(spark, sf).toPandas()
    days = comparison.leaders(spark, sf).toPandas()
    days["strategy"] = days.scheme + "|both"
    both = cells.merge(days, on=["strategy", "ticker", "date"])
    crisis = (both.crisis_prob > both.calm_prob) & (both.crisis_prob > both.stress_prob)
    assert len(both) and np.allclose(both.w, np.sign(both.p - 0.5) * np.minimum(1, 0.10 / both.garch_sigma) * ~crisis)
    table = comparison.x7_sizing_ablation(spark, sf).toPandas().set_index(["ticker", "scheme", "sizing"]).sharpe.fillna(0.0)
    for r in comparison.x7_sizing_deltas(spark, sf).collect():
        s = table[r.ticker]
        assert r.folds_without_sizing == pytest.approx(s["shuffled", "none"] - s["purged", "none"]) and r.sizing_shuffled == pytest.approx(s["shuffled", "none"] - s["shuffled", "both"])
        assert r.sizing_purged == pytest.approx(s["purged", "none"] - s["purged", "both"]) and r.regime_purged == pytest.approx(s["purged", "none"] - s["purged", "regime"])


def test_two_state_ablation(spark, sf):
    got = comparison.q10_ablation(spark, sf).toPandas().set_index(["ticker", "inputs"])
    for t in {t for t, _ in got.index}:
        assert got.loc[(t, "all")].gain == pytest.approx(got.loc[(t, "all")].sharpe - got.loc[(t, "agent")].sharpe) and got.loc[(t, "agent")].gain == 0
    learner = experiments.q10_meta_against_rule(spark, sf).where("strategy = 'learner'").toPandas().set_index("ticker")
    assert np.allclose(learner.sharpe.sort_index(), got.xs("all", level="inputs").sharpe.sort_index())
    shap = comparison.q10_importance(spark, sf).toPandas()
    assert (shap.groupby("ticker").size() == len(experiments.INPUTS)).all() and (shap.sort_values("place").groupby("ticker").shap.diff().dropna() <= 1e-12).all()
