"""Order-dependent recursions as grouped maps: one shuffle on the ticker, one task a ticker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions import kernels

GARCH = {"mu": 0.0788, "omega": 0.0144, "alpha": 0.1222, "beta": 0.8735, "var": 1.0, "shock": 0.0}
HMM = {
    "start": np.full(3, 1 / 3),
    "trans": np.array([[0.982, 0.016, 0.002], [0.020, 0.973, 0.007], [0.004, 0.018, 0.978]]),
    "means": np.array([[0.0, -0.6], [0.0, 0.1], [0.0, 1.2]]),
    "covs": np.array([np.diag([0.4, 0.2]), np.diag([1.0, 0.4]), np.diag([2.5, 1.0])]),
    "centre": np.array([0.0, 16.0]),
    "spread": np.array([1.1, 5.6]),
}
HAZARD = 1 / 250


def per_ticker(df: DataFrame, columns: str, step: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """Rows of each ticker in date order, with the columns that step gives; NaN comes out as null."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", kind="stable").reset_index(drop=True)
        return rows.assign(**{k: pd.array(v, dtype="Float64") if np.asarray(v).dtype.kind == "f" else v for k, v in step(rows).items()})

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    out = df.groupBy("ticker").applyInPandas(lambda rows: _nulls(run(rows)), f"{schema}, {columns}")
    return out


def _nulls(rows: pd.DataFrame) -> pd.DataFrame:
    for c in rows.columns:
        if str(rows[c].dtype) == "Float64":
            x = rows[c].to_numpy(dtype=float, na_value=np.nan)
            rows[c] = pd.array(np.where(np.isnan(x), 0.0, x), dtype="Float64")
            rows.loc[np.isnan(x), c] = pd.NA
    return rows


def rsi(bars: DataFrame) -> DataFrame:
    """bars (ticker, date, close) with rsi_14."""
    return per_ticker(bars.select("ticker", "date", "close"), "rsi_14 double", lambda d: {"rsi_14": kernels.rsi(d["close"].to_numpy())})


def garch(returns: DataFrame, params: dict = GARCH) -> DataFrame:
    """returns (ticker, date, r; no nulls) with sigma, the annualised volatility before r is seen."""
    return per_ticker(returns, "sigma double", lambda d: {"sigma": kernels.garch_path(d["r"].to_numpy(), **params)})


def _densities(d: pd.DataFrame, model: dict) -> np.ndarray:
    """Scaled as the model's own fit was, so that no row depends on later ones."""
    return kernels.log_gauss((d[["r", "rv"]].to_numpy(dtype=float) - model["centre"]) / model["spread"], model["means"], model["covs"])


def regimes(inputs: DataFrame, model: dict = HMM) -> DataFrame:
    """inputs (ticker, date, r, rv) with filtered and smoothed probabilities and the Viterbi state."""

    def step(d: pd.DataFrame) -> dict:
        dens = _densities(d, model)
        now, smooth = (f(dens, model["start"], model["trans"]) for f in (kernels.hmm_filter, kernels.hmm_smooth))
        out = {n: now[:, i] for i, n in enumerate(("calm", "stress", "crisis"))} | {f"smooth_{n}": smooth[:, i] for i, n in enumerate(("calm", "stress", "crisis"))}
        return out | {"state": kernels.viterbi(dens, model["start"], model["trans"])}

    return per_ticker(inputs, "calm double, stress double, crisis double, smooth_calm double, smooth_stress double, smooth_crisis double, state long", step)


def decoded_so_far(inputs: DataFrame, model: dict = HMM) -> DataFrame:
    """inputs (ticker, date, r, rv) with the state that the likeliest path up to each row ends in."""
    return per_ticker(inputs, "state long", lambda d: {"state": kernels.viterbi_ends(_densities(d, model), model["start"], model["trans"])})


def regime_filter(inputs: DataFrame, model: dict = HMM) -> DataFrame:
    """inputs (ticker, date, r, rv) with the filtered probabilities alone: P(state | rows so far)."""

    def step(d: pd.DataFrame) -> dict:
        now = kernels.hmm_filter(_densities(d, model), model["start"], model["trans"])
        return {n: now[:, i] for i, n in enumerate(("calm", "stress", "crisis"))}

    return per_ticker(inputs, "calm double, stress double, crisis double", step)


def market(inputs: DataFrame, model: dict = HMM, params: dict = GARCH) -> DataFrame:
    """inputs (ticker, date, r, rv) with sigma and the filtered calm, stress and crisis: both recursions in one pass over a ticker.

    sigma is null where r is, the probabilities where rv is; those rows leave the recursion as it was."""

    def step(d: pd.DataFrame) -> dict:
        out = {n: np.full(len(d), np.nan) for n in ("sigma", "calm", "stress", "crisis")}
        seen, fine = d["r"].notna().to_numpy(), (d["r"].notna() & d["rv"].notna()).to_numpy()
        out["sigma"][seen] = kernels.garch_path(d["r"].to_numpy(dtype=float)[seen], **params)
        now = kernels.hmm_filter(_densities(d[fine], model), model["start"], model["trans"])
        for i, n in enumerate(("calm", "stress", "crisis")):
            out[n][fine] = now[:, i]
        return out

    return per_ticker(inputs, "sigma double, calm double, stress double, crisis double", step)


def change_points(series: DataFrame, column: str, hazard: float = HAZARD, window: int = 5) -> DataFrame:
    """series with map_run_length and cp_prob of a column (nulls count as 0)."""

    def step(d: pd.DataFrame) -> dict:
        best, near = kernels.bocpd(d[column].fillna(0.0).to_numpy(), hazard, window)
        return {"map_run_length": best, "cp_prob": near}

    return per_ticker(series, "map_run_length long, cp_prob double", step)


def change_points_pruned(series: DataFrame, column: str, hazard: float = HAZARD, window: int = 5, drop: float = 1e-20) -> DataFrame:
    """change_points() without the runs that have become impossible: time grows with rows times the length of a regime. Also the
    share of the posterior that has been dropped up to each row, and the number of runs held. drop = 0 drops none."""

    def step(d: pd.DataFrame) -> dict:
        best, near, lost, held = kernels.bocpd_pruned(d[column].fillna(0.0).to_numpy(dtype=float), hazard, window, drop)
        return {"map_run_length": best, "cp_prob": near, "lost": lost, "held": held}

    return per_ticker(series, "map_run_length long, cp_prob double, lost double, held long", step)


def sizing_anomaly(series: DataFrame, column: str = "size", hazard: float = HAZARD, window: int = 5, signal: str = "cp_prob") -> DataFrame:
    """series with map_run_length, psa (score) and psa_ready: whether the history up to the row is long enough.

    signal: cp_prob (levels), cp_prob_delta (increments) or map_runlength. Scores are rounded to 9 digits, 0 where not ready.
    """
    if signal not in ("cp_prob", "cp_prob_delta", "map_runlength"):
        raise ValueError(f"unknown signal {signal}")
    delta = signal == "cp_prob_delta"
    least = window + 2 + delta

    def step(d: pd.DataFrame) -> dict:
        x = d[column].fillna(0.0).to_numpy(dtype=float)
        best, near = kernels.bocpd(np.diff(x) if delta else x, hazard, window)
        if delta and len(x):
            best, near = np.insert(best, 0, 0), np.insert(near, 0, 0.0)
        ready = np.arange(1, len(x) + 1) >= least
        score = np.maximum(0, window - best) / window if signal == "map_runlength" else near
        return {"map_run_length": best, "psa": np.where(ready, np.round(score, 9), 0.0), "psa_ready": ready}

    return per_ticker(series, "map_run_length long, psa double, psa_ready boolean", step)
