"""Paired tests, resampling and calibration. Sums are Spark aggregations; only their results meet Python."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import special
from tidemark.functions.kernels import generator, mean_block, stationary_bootstrap
from tidemark.functions.series import average_rank, spread
from tidemark.functions.special import N01

SEED = 42


def deflated_sharpe(sr: float, trials: int, n: int, skew: float = 0.0, kurt: float = 3.0) -> float:
    """P(true Sharpe > best of `trials` by chance); sr per period, kurt not in excess."""
    if n < 2:
        return math.nan
    euler = 0.5772156649015329
    best = 0.0 if trials < 2 else math.sqrt(1 / (n - 1)) * ((1 - euler) * N01.inv_cdf(1 - 1 / trials) + euler * N01.inv_cdf(1 - 1 / (trials * math.e)))
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr**2
    return math.nan if spread <= 0 else N01.cdf((sr - best) * math.sqrt(n - 1) / math.sqrt(spread))


def mcnemar_p(b: int, c: int) -> float:
    """Exact below 25 discordant pairs, chi-squared with continuity correction from there."""
    n = b + c
    return 1.0 if not n else special.binomial_two_sided(b, n) if n < 25 else special.chi2_1_tail((abs(b - c) - 1) ** 2 / n)


def sign_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson."""

    def solve(f: Callable[[float], float]) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        return (lo + hi) / 2

    tail = (1 - level) / 2
    low = 0.0 if k == 0 else solve(lambda p: special.binomial_tail(k, n, p) - tail)
    high = 1.0 if k == n else solve(lambda p: special.binomial_tail(k + 1, n, p) - (1 - tail))
    return low, high


def diebold_mariano(losses: DataFrame, h: int = 1) -> DataFrame:
    """key, n, mean, dm, p of losses (key, date, d: loss difference); autocovariances up to h - 1, twice, over n - lag terms."""
    order = W.partitionBy("key").orderBy("date")
    df = losses.withColumn("m", F.avg("d").over(W.partitionBy("key"))) if h > 1 else losses
    lags = [((F.col("d") - F.col("m")) * (F.lag("d", k).over(order) - F.col("m"))).alias(f"g{k}") for k in range(1, h)]
    df = df.select("key", "d", *lags)
    var = F.var_pop("d") + 2 * sum((F.avg(f"g{k}") for k in range(1, h)), F.lit(0.0))
    out = df.groupBy("key").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), var.alias("var"))
    out = out.withColumn("dm", F.when(F.col("var") > 0, F.col("mean") / F.sqrt(F.col("var") / F.col("n"))))
    return out.select("key", "n", "mean", "dm", two_sided("dm").alias("p"))


@F.pandas_udf(DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Of a standard normal; null stays null."""
    return z.map(lambda v: None if pd.isna(v) else special.normal_two_sided(v))


@F.pandas_udf(DoubleType())
def mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(b, c, strict=True)])


@F.pandas_udf(DoubleType())
def correlation_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a rank correlation, by the t distribution with n - 2 degrees; null under 3 rows."""

    def one(r: float, k: int) -> float | None:
        if pd.isna(r) or k < 3:
            return None
        return 0.0 if abs(r) >= 1 else 2 * special.t_tail(abs(r) * math.sqrt((k - 2) / (1 - r * r)), k - 2)

    return pd.Series([one(r, int(k)) for r, k in zip(rho, n, strict=True)], dtype="Float64").astype(object).where(lambda v: v.notna(), None)


def spearman(df: DataFrame, x: str, y: str, *key: str) -> DataFrame:
    """key, rho, p, n: rank correlation, equal values sharing the mean of their ranks."""
    ranks = [average_rank(F.col(c), *(key or [F.lit(0)])) for c in (x, y)]
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, ranks[0].alias("a"), ranks[1].alias("b")).groupBy(*key).agg(F.corr("a", "b").alias("rho"), F.count("*").alias("n"))
    return out.withColumn("p", correlation_p("rho", "n"))


def tost_p(mean: float, sd: float, n: int, margin: float) -> float:
    """The larger of two one-sided p-values for |mean| < margin."""
    se = sd / math.sqrt(n)
    if se == 0:
        return 0.0 if abs(mean) < margin else 1.0
    return max(special.t_tail((mean + margin) / se, n - 1), special.t_tail(-(mean - margin) / se, n - 1))


def replicates(data: np.ndarray, statistic: Callable[[np.ndarray], float], reps: int, block: float | None, seed: int) -> np.ndarray:
    """The statistic of each resample, drawn by one generator in order. block: mean length of stationary blocks (0:
    independent rows; none: the rounded square root of the length, 2 at least)."""
    n, rng = len(data), np.random.default_rng(seed)
    mean = mean_block(n) if block is None else block
    return np.array([statistic(data[stationary_bootstrap(n, rng, mean) if mean else rng.integers(0, n, n)]) for _ in range(reps)])


def bootstrap(data: np.ndarray, statistic: Callable[[np.ndarray], float] = np.mean, reps: int = 1000, block: float | None = None, seed: int = SEED) -> tuple[float, float, float]:
    """Point value and 95 % percentile interval of one series; NaN under two rows. Replicates that give no number are left out."""
    data = np.asarray(data, dtype=float)
    if len(data) < 2:
        return (float(statistic(data)) if len(data) else math.nan), math.nan, math.nan
    with np.errstate(invalid="ignore", divide="ignore"):
        got = replicates(data, statistic, reps, block, seed)
        point = float(statistic(data))
    low, high = np.quantile(got[~np.isnan(got)], [0.025, 0.975]) if (~np.isnan(got)).any() else (math.nan, math.nan)
    return point, float(low), float(high)


def sharpe_difference(pair: np.ndarray) -> float:
    """Of two columns drawn together; population deviations."""
    s = pair.std(axis=0)
    return float((pair.mean(axis=0) / np.where(s > 0, s, np.nan) * math.sqrt(252)) @ np.array([1.0, -1.0]))


def block_permutation_p(d: np.ndarray, reps: int = 10_000, seed: int = SEED) -> float:
    """Share of sign flips of whole blocks whose sum is as far from 0 as seen. Block sums carry all that a flip needs."""
    d = np.asarray(d, dtype=float)
    if not len(d):
        return math.nan
    sums = np.add.reduceat(d, np.arange(0, len(d), max(1, round(math.sqrt(len(d))))))
    rng, hits = np.random.default_rng(seed), 0
    for at in range(0, reps, 1000):
        flips = rng.choice((-1.0, 1.0), size=(min(1000, reps - at), len(sums)))
        hits += int((np.abs(flips @ sums) >= abs(sums.sum()) - 1e-9).sum())
    return hits / reps


def crossings(conf: np.ndarray, right: np.ndarray, penalty: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """For each row of conf and right (samples x n): where the fitted probability of being right crosses one half (NaN if it
    does not rise through it inside (0, 1)), and the slope."""
    a, b, moving = np.zeros(len(conf)), np.zeros(len(conf)), np.ones(len(conf), dtype=bool)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a[:, None] + b[:, None] * conf, -35, 35)))
        gap, w = right - p, p * (1 - p)
        ga, gb = gap.sum(axis=1), (gap * conf).sum(axis=1) - penalty * b
        aa, ab, bb = w.sum(axis=1) + 1e-9, (w * conf).sum(axis=1), (w * conf * conf).sum(axis=1) + penalty
        det = np.maximum(aa * bb - ab * ab, 1e-18)
        da, db = (bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det
        limit = np.maximum(1.0, np.maximum(np.abs(da), np.abs(db)) / 10)
        a, b = a + np.where(moving, da / limit, 0.0), b + np.where(moving, db / limit, 0.0)
        moving &= np.maximum(np.abs(da), np.abs(db)) >= 1e-9  # a row is done by itself, whatever stands beside it
        if not moving.any():
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        tau = np.where(b > 0, -a / np.where(b > 0, b, 1.0), np.nan)
    mixed = (right.min(axis=1) < right.max(axis=1)) & (tau > 0) & (tau < 1)
    return np.where(mixed, tau, np.nan), b


def gate(conf: np.ndarray, right: np.ndarray, reps: int = 1000, seed: int = SEED) -> dict:
    """tau (median of resamples), tau_point, low, high, identified, share (of resamples that have a crossing), slope.

    Without a crossing of the whole series, or of any resample, the gate abstains: tau, low and high are NaN."""
    conf, right = np.asarray(conf, dtype=float), np.asarray(right, dtype=float)
    point, slope = (v[0] for v in crossings(conf[None], right[None]))
    n, rng, taus = len(conf), np.random.default_rng(seed), []
    mean, size = mean_block(n), max(1, 2_000_000 // n)
    for at in range(0, reps, size):
        index = np.stack([stationary_bootstrap(n, rng, mean) for _ in range(min(size, reps - at))])
        taus.append(crossings(conf[index], right[index])[0])
    found = np.concatenate(taus)
    share = float(np.isfinite(found).mean())
    identified = bool(np.isfinite(point))
    tau, low, high = (np.nanmedian(found), *np.nanpercentile(found, [2.5, 97.5])) if identified and share > 0 else (math.nan,) * 3
    return {"tau": float(tau), "tau_point": float(point), "low": float(low), "high": float(high), "identified": identified, "share": share, "slope": float(slope)}


def by_key(df: DataFrame, key: str, step: Callable[[pd.DataFrame], dict], columns: str) -> DataFrame:
    """One row a key: what step gives for its rows in date order; NaN comes out as null. A key's series is one task's work."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = step(rows.sort_values("date", kind="stable"))
        plain = {k: (None if isinstance(v, float) and math.isnan(v) else v) for k, v in got.items()}
        return pd.DataFrame({key: [rows[key].iloc[0]], **{k: pd.Series([v], dtype=object) for k, v in plain.items()}})

    return spread(df, key).groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {columns}")


class Draw(NamedTuple):
    """A statistic that is replicated: its columns, its value on the series, and its values under some generators."""

    columns: tuple[str, ...]
    point: Callable[[np.ndarray], float]
    draw: Callable[[list[np.random.Generator], np.ndarray], np.ndarray]


def resampled(statistic: Callable[[np.ndarray], float], *columns: str, block: float | None = None) -> Draw:
    """Of the rows of a series drawn again: stationary blocks of mean length `block` (0: independent rows; none: the rounded
    square root of the length, 2 at least). One column comes as a vector, several as a matrix."""
    flat = lambda x: x[:, 0] if len(columns) == 1 else x

    def draw(rngs: list[np.random.Generator], data: np.ndarray) -> np.ndarray:
        n = len(data)
        mean = mean_block(n) if block is None else block
        return np.array([statistic(flat(data[stationary_bootstrap(n, g, mean) if mean else g.integers(0, n, n)])) for g in rngs])

    return Draw(columns, lambda x: statistic(flat(x)), draw)


def flipped(column: str) -> Draw:
    """1 where a sign flip of whole blocks moves the sum as far from 0 as it is: the mean is block_permutation_p."""

    def draw(rngs: list[np.random.Generator], data: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(data[:, 0], np.arange(0, len(data), max(1, round(math.sqrt(len(data))))))
        flips = np.stack([g.choice((-1.0, 1.0), size=len(sums)) for g in rngs])
        return (np.abs(flips @ sums) >= abs(sums.sum()) - 1e-9).astype(float)

    return Draw((column,), lambda x: float(x.sum()), draw)


def replicated(df: DataFrame, key: str, draws: dict[str, Draw], reps: int = 1000, per: int = 100, seed: int = SEED) -> DataFrame:
    """key, name, replicate (-1: the value on the series itself), value (null: no number) of df (key, date, columns).

    `per` replicates of a key are a task's work, on that key's rows where none of a statistic's columns is null, in date
    order. Replicate i has the seed's generator jumped ahead i times, so the numbers do not depend on how they are dealt."""
    columns = list(dict.fromkeys(c for d in draws.values() for c in d.columns))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-reps // per) - 1)))).alias("part")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, part = rows.sort_values("date", kind="stable"), int(rows["part"].iloc[0])
        numbers, out = range(part * per, min(reps, (part + 1) * per)), []
        for name, d in draws.items():
            data = rows[list(d.columns)].dropna().to_numpy(dtype=float)
            with np.errstate(invalid="ignore", divide="ignore"):
                if not part and len(data):
                    out.append((name, -1, d.point(data)))
                if len(data) > 1 and len(numbers):
                    out += [(name, i, v) for i, v in zip(numbers, d.draw([generator(seed, i) for i in numbers], data), strict=True)]
        got = pd.DataFrame(out, columns=["name", "replicate", "value"])
        value = got["value"].astype(float)
        return pd.DataFrame({key: rows[key].iloc[0], "name": got["name"], "replicate": got["replicate"], "value": value.astype(object).where(value.notna(), None)})

    kind = df.schema[key].dataType.simpleString()
    long = df.select(key, "date", *columns, blocks)
    return spread(long, key, "part").groupBy(key, "part").applyInPandas(run, f"{key} {kind}, name string, replicate int, value double")


def intervals(values: DataFrame, key: str, level: float = 0.95) -> DataFrame:
    """key, name, point, mean, low, high, n of replicated()'s rows: percentile intervals over the replicates that gave a number."""
    drawn = F.when(F.col("replicate") >= 0, F.col("value"))
    tail = (1 - level) / 2
    return values.groupBy(key, "name").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("point"), F.avg(drawn).alias("mean"),
        F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high"), F.count(drawn).alias("n"),
    )


def gates(days: DataFrame, key: str, reps: int = 1000, per: int = 100) -> DataFrame:
    """key and what gate() gives of days (key, date, conf, right), with the replicates of a key dealt to many tasks."""

    def draw(rngs: list[np.random.Generator], data: np.ndarray) -> np.ndarray:
        index = np.stack([stationary_bootstrap(len(data), g, mean_block(len(data))) for g in rngs])
        return crossings(data[:, 0][index], data[:, 1][index])[0]

    whole = lambda k: lambda x: float(crossings(x[None, :, 0], x[None, :, 1])[k][0])
    none = Draw(("conf", "right"), whole(1), lambda rngs, x: np.full(len(rngs), np.nan))
    values = replicated(days, key, {"tau": Draw(("conf", "right"), whole(0), draw), "slope": none}, reps, per)
    is_tau, drawn = F.col("name") == "tau", F.col("replicate") >= 0
    point = lambda n: F.max(F.when((F.col("name") == n) & ~drawn, F.col("value")))
    taus = F.when(is_tau & drawn, F.col("value"))
    out = values.groupBy(key).agg(
        F.percentile(taus, F.lit(0.5)).alias("tau"), point("tau").alias("tau_point"), F.percentile(taus, F.lit(0.025)).alias("low"), F.percentile(taus, F.lit(0.975)).alias("high"),
        (F.count(taus) / F.nullif(F.count_if(is_tau & drawn), F.lit(0))).alias("share"), point("slope").alias("slope"),
    )
    known = F.col("tau_point").isNotNull()
    only = lambda c: F.when(known, F.col(c)).alias(c)
    return out.select(key, only("tau"), "tau_point", only("low"), only("high"), known.alias("identified"), "share", "slope")


def isotonic_crossing(mids: np.ndarray, share: np.ndarray, weight: np.ndarray) -> float:
    """First of 501 grid points at which the increasing regression of share on mids, interpolated, reaches one half; NaN if none
    does, or with fewer than two bins."""
    if len(mids) < 2:
        return math.nan
    pools: list[list[float]] = []
    for v, w in zip(share, weight, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    fitted = np.concatenate([[v] * int(k) for v, _, k in pools])
    grid = np.linspace(0, 1, 501)
    over = grid[np.interp(grid, mids, fitted) >= 0.5]
    return float(over[0]) if len(over) else math.nan


def isotonic_gates(days: DataFrame, *key: str) -> DataFrame:
    """key, tau (null: abstain) of days (key, conf, right). Ten bins, closed below; confidence 1 is in none of them."""
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(0, 1, 11)])
    b = F.size(F.filter(edges, lambda e: e <= F.col("conf"))) - 1
    bins = days.withColumn("b", b).where("b between 0 and 9").groupBy(*key, "b").agg(F.avg(F.col("right").cast("double")).alias("share"), F.count("*").alias("w"))
    whole = bins.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("b", "share", "w"))).alias("bins"))  # ten at most

    @F.pandas_udf("double")
    def tau(bins: pd.Series) -> pd.Series:
        def one(rows) -> float | None:
            b, share, w = (np.array([r[c] for r in rows], dtype=float) for c in ("b", "share", "w"))
            got = isotonic_crossing((b + 0.5) / 10, share, w)
            return None if math.isnan(got) else got

        return bins.map(one).astype(object)

    return whole.select(*key, tau("bins").alias("tau"))


def information_criteria(loglik: float, k: int, dims: int, n: int) -> tuple[float, float]:
    """AIC and BIC of a Gaussian hidden Markov model with full covariances."""
    free = (k - 1) + k * (k - 1) + k * dims + k * dims * (dims + 1) // 2
    return 2 * free - 2 * loglik, free * math.log(n) - 2 * loglik


def refutes(gain, p, b, c):
    """Whether a variant improves the direction beyond doubt: more than 2 points, p under 0.10, and b (won) above c (lost)."""
    return (gain > 0.02) & (p < 0.10) & (b > c)
