"""Named queries of the supervision workflow: market states, the daily table, calibration, learning, and the panel experiments.

Bars, decisions, orders and personalities come from sources.bridge. Rows up to CALIBRATION_END calibrate, later ones test.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import kernels, special, text
from tidemark.functions.series import by, filled_forward, log_return, rolling, rounded
from tidemark.operators import backtest, folds, inference, learning, macro, models, recursions, scans, supervision
from tidemark.operators.selection import percentiles
from tidemark.plans.registry import DET_SQL, MODES, ONE, ROLL, STRATEGIES, WIN, R, detected, labelled, matthews, query, r6, ran, rets
from tidemark.sources import bridge
from tidemark.sources.scratch import once, shared_folder, written

CALIBRATION_END = "1999-12-31"
TAU = 0.5
PERCENTS = (50, 75, 90, 95, 99)
VALID = "r_next is not null and r_next <> 0"
PERSONA_FEATURES = [f"{n}_{part}" for n in bridge.PERSONAS for part in ("sign", "size", "conf")]
MARKET_FEATURES = ["ram_score", "psa_score", "gso_score", "calm_prob", "stress_prob", "crisis_prob", "garch_sigma"]


def kept(spark, d, name: str, make) -> DataFrame:
    """make()'s table, shared by the queries of an application over the same orders."""
    return once(spark, name, f"{d}/orders.parquet", make)


def features(spark, d) -> DataFrame:
    """ticker, date, close, r, rv (annualised deviation of 21 returns) and r_next on the market's calendar."""
    df = bridge.bars(spark, d).select("ticker", "date", "close", log_return(F.col("close")).alias("r"))
    df = df.withColumns({"rv": rolling(F.stddev_samp, F.col("r"), 21) * 252**0.5, "r_next": F.lead("r").over(by())})
    return df.withColumn("rv", F.when(F.col("r").isNotNull(), F.col("rv")))


def calibration(df: DataFrame) -> DataFrame:
    return df.where(F.col("date") <= CALIBRATION_END)


def inputs(spark, d) -> DataFrame:
    return features(spark, d).where("rv is not null")


def _density(k: int) -> str:
    m, v = recursions.HMM["means"][k], np.diag(recursions.HMM["covs"][k])
    c, s = recursions.HMM["centre"], recursions.HMM["spread"]
    parts = [f"(({x} - {float(c[i])}::DOUBLE) / {float(s[i])}::DOUBLE - {float(m[i])}::DOUBLE) ** 2 / {float(v[i])}::DOUBLE" for i, x in enumerate(("r", "rv"))]
    return f"-0.5::DOUBLE * ({' + '.join(parts)}) - {float(0.5 * np.log(v.prod()))}::DOUBLE"


def _moved(j: int) -> str:
    t = recursions.HMM["trans"]
    return " + ".join(f"{n} * {float(t[i, j])}::DOUBLE" for i, n in enumerate(("calm", "stress", "crisis")))


FEATURES_SQL = f"""f AS (SELECT *, CASE WHEN r IS NOT NULL THEN {ROLL('stddev_samp', 'r', 21)} * sqrt(252) END AS rv, lead(r) {WIN} AS r_next FROM rets),
 gs AS (SELECT ticker, date, row_number() {WIN} AS i, r FROM rets WHERE r IS NOT NULL),
 gp AS (SELECT ticker, date, i, r, 0.0144::DOUBLE + 0.8735::DOUBLE AS v FROM gs WHERE i = 1
  UNION ALL SELECT gs.ticker, gs.date, gs.i, gs.r, 0.0144::DOUBLE + 0.1222::DOUBLE * (100 * p.r - 0.0788::DOUBLE) ** 2 + 0.8735::DOUBLE * p.v FROM gp p JOIN gs ON gs.ticker = p.ticker AND gs.i = p.i + 1),
 de AS (SELECT ticker, date, row_number() {WIN} AS i, {', '.join(f'{_density(k)} AS l{k}' for k in range(3))} FROM f WHERE rv IS NOT NULL),
 ex AS (SELECT ticker, date, i, {', '.join(f'exp(l{k} - greatest(l0, l1, l2)) AS e{k}' for k in range(3))} FROM de),
 hm AS (SELECT ticker, date, i, e0 / (e0 + e1 + e2) AS calm, e1 / (e0 + e1 + e2) AS stress, e2 / (e0 + e1 + e2) AS crisis FROM ex WHERE i = 1
  UNION ALL SELECT ticker, date, i, u0 / (u0 + u1 + u2), u1 / (u0 + u1 + u2), u2 / (u0 + u1 + u2) FROM
   (SELECT ex.ticker, ex.date, ex.i, {', '.join(f'e{j} * ({_moved(j)}) AS u{j}' for j in range(3))} FROM hm JOIN ex ON ex.ticker = hm.ticker AND ex.i = hm.i + 1)),
 ms AS (SELECT f.ticker, f.date, f.r, f.r_next, hm.calm, hm.stress, hm.crisis, sqrt(gp.v * 252) / 100 AS sigma FROM f JOIN hm USING (ticker, date) JOIN gp USING (ticker, date))"""


def points_sql(series: str, name: str = "b") -> str:
    """Recursive CTE (ticker, i, cp, best, ...) of change points over the CTE `series` (ticker, i, x)."""
    h = recursions.HAZARD
    scale = "b.be[k+1] * (2 + k) / ((1 + k / 2) * (1 + k))"
    near = f"b.lr[k+1] + lgamma((3 + k) / 2) - lgamma((2 + k) / 2) - 0.5 * ln((2 + k) * pi() * {scale}) - (3 + k) / 2 * ln(1 + (s.x - b.mu[k+1]) ** 2 / ((2 + k) * {scale}))"
    return f"""{name} AS (SELECT ticker, 0::BIGINT AS i, [0.0::DOUBLE] AS lr, [0.0::DOUBLE] AS mu, [1.0::DOUBLE] AS be, 0.0::DOUBLE AS cp, 0::BIGINT AS best FROM (SELECT DISTINCT ticker FROM {series})
 UNION ALL SELECT ticker, i, lr, mu, be, list_sum(list_transform(lr[1:6], lambda v: exp(v))) AS cp, list_position(lr, list_max(lr)) - 1 AS best FROM (
  SELECT ticker, i, list_prepend(ln({h}), list_transform(j, lambda v: v - z + ln(1 - {h}))) AS lr, mu, be FROM (
   SELECT ticker, i, j, list_max(j) + ln(list_sum(list_transform(j, lambda v: exp(v - list_max(j))))) AS z, mu, be FROM (
    SELECT s.ticker, s.i, list_transform(range(len(b.lr)), lambda k: {near}) AS j,
     list_prepend(0.0::DOUBLE, list_transform(range(len(b.mu)), lambda k: ((1 + k) * b.mu[k+1] + s.x) / (2 + k))) AS mu,
     list_prepend(1.0::DOUBLE, list_transform(range(len(b.mu)), lambda k: b.be[k+1] + (1 + k) * (s.x - b.mu[k+1]) ** 2 / (2 * (2 + k)))) AS be
    FROM {name} b JOIN {series} s ON s.ticker = b.ticker AND s.i = b.i + 1))))"""


SEVERITY = lambda x, low, medium, high: f"CASE WHEN {x} >= {high} THEN 3 WHEN {x} >= {medium} THEN 2 WHEN {x} >= {low} THEN 1 ELSE 0 END"
NAMES = lambda c: f"['none', 'low', 'medium', 'high'][{c} + 1]"


@query(f", {FEATURES_SQL} SELECT ticker, date, {R('calm')} AS calm, {R('stress')} AS stress, {R('crisis')} AS crisis FROM hm")
def st5_regime_filter(spark, d):
    """P(state | returns and volatilities so far), by a model with fixed parameters."""
    out = recursions.regime_filter(inputs(spark, d).select("ticker", "date", "r", "rv"))
    return out.select("ticker", "date", *r6(**{c: F.col(c) for c in ("calm", "stress", "crisis")}))


@query(f", {FEATURES_SQL} SELECT ticker, date, {R('calm')} AS calm, {R('stress')} AS stress, {R('crisis')} AS crisis FROM hm")
def st5_regime_filter_blocks(spark, d):
    """The same by blocks of each series in different tasks."""
    out = scans.regime_filter(inputs(spark, d).select("ticker", "date", "r", "rv"))
    return out.select("ticker", "date", *r6(**{c: F.col(c) for c in ("calm", "stress", "crisis")}))


@query(f", {FEATURES_SQL} SELECT ticker, date, {R('sqrt(v * 252) / 100')} AS sigma FROM gp")
def st2_garch_blocks(spark, d):
    """The volatility path by blocks of each series in different tasks."""
    out = scans.garch(rets(spark, d).where("r is not null").select("ticker", "date", "r"))
    return out.select("ticker", "date", *r6(sigma=F.col("sigma")))


@query("SELECT ticker, count(*) AS n, " + ", ".join(f"{R(f'quantile_cont(abs(r), {p / 100})')} AS p{p}" for p in PERCENTS) + " FROM rets WHERE r IS NOT NULL GROUP BY ticker")
def m19_percentiles_by_counts(spark, d):
    """Percentiles of absolute returns by counting, without a buffer of a ticker's values."""
    got = percentiles(rets(spark, d), F.abs("r"), [p / 100 for p in PERCENTS], "ticker")
    return got.groupBy("ticker", "n").agg(*[rounded(F.max(F.when(F.abs(F.col("share") - p / 100) < 1e-9, F.col("value")))).alias(f"p{p}") for p in PERCENTS])


@query()
def st5_st7_regimes(spark, d):
    return recursions.regimes(inputs(spark, d).select("ticker", "date", "r", "rv"))


@query(f", s AS (SELECT ticker, date, row_number() {WIN} AS i, size AS x FROM dec), {points_sql('s')} SELECT s.ticker, s.date, s.x AS size, b.best AS map_run_length, {R('b.cp')} AS cp_prob, CASE WHEN b.best <= 1 THEN 'high' WHEN b.best <= 3 THEN 'medium' WHEN b.best <= 5 THEN 'low' ELSE 'none' END AS run_severity, CASE WHEN s.i < 7 THEN 'none' ELSE {NAMES(SEVERITY('round(b.cp, 9)', 0.2, 0.4, 0.7))} END AS psa_severity FROM s JOIN b USING (ticker, i)")
def st9_d2_change_points(spark, d):
    """Change points of sizes, one expected in 250 rows, and the severities of the sizing check by the uncalibrated cuts."""
    near = recursions.change_points(bridge.decisions(spark, d).select("ticker", "date", "size"), "size")
    level = F.when(F.row_number().over(by()) >= 7, supervision.severity(F.round("cp_prob", 9), supervision.CUTS["psa"])).otherwise("none")
    return near.select("ticker", "date", "size", "map_run_length", *r6(cp_prob=F.col("cp_prob")), supervision.run_length_severity(F.col("map_run_length"), 5).alias("run_severity"), level.alias("psa_severity"))


@query(f", s AS (SELECT ticker, date, row_number() {WIN} AS i, size AS x FROM dec), {points_sql('s')} SELECT s.ticker, s.date, b.best AS map_run_length, {R('b.cp')} AS cp_prob FROM s JOIN b USING (ticker, i)")
def st9_pruned_change_points(spark, d):
    """Change points of sizes without the runs that have become impossible."""
    near = recursions.change_points_pruned(bridge.decisions(spark, d).select("ticker", "date", "size"), "size")
    return near.select("ticker", "date", "map_run_length", *r6(cp_prob=F.col("cp_prob")))


@query()
def d2_sizing_signals(spark, d):
    """The sizing check by each of its signals: levels, increments, run length."""
    base = bridge.decisions(spark, d).select("ticker", "date", "size")
    out = None
    for signal in ("cp_prob", "cp_prob_delta", "map_runlength"):
        one = recursions.sizing_anomaly(base, signal=signal).select("ticker", "date", F.lit(signal).alias("signal"), "psa", "map_run_length", "psa_ready")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT ticker, date, word, CASE WHEN word IN ('buy', 'cover', 'bullish') THEN 'long' WHEN word IN ('short', 'sell', 'bearish') THEN 'short' ELSE 'hold' END AS action, " + R("CASE WHEN word = 'hold' OR quantity <= 0 OR price <= 0 OR cash <= 0 THEN 0 ELSE least(1, quantity * price / cash) * CASE WHEN word IN ('short', 'sell') THEN -1 ELSE 1 END END") + " AS size FROM (SELECT ticker, date, " + f"[{', '.join(repr(w) for w in bridge.WORDS)}][CAST(ok % {len(bridge.WORDS)} + 1 AS INT)] AS word, ck % 41 - 2 AS quantity, close AS price, ok % 9 * 250000.0::DOUBLE AS cash FROM daily WHERE ok % 7 <> 0)")
def f11_f12_orders(spark, d):
    """Orders in words and quantities as actions and sizes."""
    df = bridge.orders(spark, d)
    size = supervision.size_of(F.col("word"), F.col("quantity"), F.col("price"), F.col("cash"))
    return df.select("ticker", "date", "word", supervision.action_of(F.col("word")).alias("action"), *r6(size=size))


def persona_columns(df: DataFrame) -> list[Column]:
    """sign, size and conf of each personality, 0 where it is absent."""
    out = []
    for n in bridge.PERSONAS:
        p = F.col("personalities")[n]
        sign = F.when(p["action"] == "long", 1.0).when(p["action"] == "short", -1.0).otherwise(0.0)
        out += [sign.alias(f"{n}_sign"), F.coalesce(p["size"], F.lit(0.0)).alias(f"{n}_size"), F.coalesce(p["confidence"], F.lit(0.0)).alias(f"{n}_conf")]
    return out


_PERSONA_SQL = ", ".join(f"CASE WHEN ok % 11 = {i} THEN 0 ELSE [1.0::DOUBLE, -1, 0][CAST((ck + {i}) % 3 + 1 AS INT)] END AS {n}_sign, 0.0::DOUBLE AS {n}_size, CASE WHEN ok % 11 = {i} THEN 0 ELSE (ok + {7 * i}) % 101 / 100.0::DOUBLE END AS {n}_conf" for i, n in enumerate(bridge.PERSONAS))


@query(f"SELECT ticker, date, {_PERSONA_SQL} FROM daily WHERE ok % 7 <> 0")
def f14_persona_features(spark, d):
    df = bridge.personas(spark, d)
    return df.select("ticker", "date", *persona_columns(df))


def market(spark, d) -> DataFrame:
    """ticker, date, r, r_next, sigma, calm, stress, crisis where both recursions have a value, by fixed parameters."""
    def make() -> DataFrame:
        states = recursions.market(features(spark, d).select("ticker", "date", "r", "rv", "r_next"))
        return states.where("sigma is not null and calm is not null").select("ticker", "date", "r", "r_next", "sigma", "calm", "stress", "crisis")

    return kept(spark, d, "market", make)


@query(f", {FEATURES_SQL} SELECT ticker, date, {R('sigma')} AS sigma, {R('calm')} AS calm, {R('stress')} AS stress, {R('crisis')} AS crisis, {R('1.645::DOUBLE * sigma / sqrt(252)')} AS var_95 FROM ms")
def q2_f18_market_states(spark, d):
    """Volatility path, filtered regimes, and the band that a normal return leaves downwards one day in twenty."""
    return market(spark, d).select("ticker", "date", *r6(**{c: F.col(c) for c in ("sigma", "calm", "stress", "crisis")}, var_95=1.645 * F.col("sigma") / 252**0.5))


def sizing_scores(states: DataFrame) -> DataFrame:
    """ticker, date, psa: scores of the best sizing that regimes and volatility give, over calibration days with enough history."""
    sign = F.when(F.col("calm") >= F.col("crisis"), 1.0).otherwise(-1.0)
    best = calibration(states).select("ticker", "date", (sign * supervision.gso_bound(F.col("sigma"))).alias("size"))
    return recursions.sizing_anomaly(best).where("psa_ready").select("ticker", "date", "psa")


def cuts_of(states: DataFrame) -> DataFrame:
    """Cuts by ticker from calibration days, none of which looks at the agent: of the sizing scores of the best sizing, and of the
    volatility scores of an agent that is all in. The regime check's are those of a gate at one half."""
    psa = sizing_scores(states).select("ticker", F.lit("psa").alias("detector"), F.col("psa").alias("score"))
    all_in = supervision.gso_score(F.lit(1.0), supervision.gso_bound(F.col("sigma")))
    gso = calibration(states).select("ticker", F.lit("gso").alias("detector"), F.round(all_in, 9).alias("score"))
    cuts = supervision.uncalibrated(supervision.calibrated_cuts(psa.unionByName(gso)))
    return cuts.withColumns({f"ram_{c}": F.lit(v) for c, v in zip(("low", "medium", "high"), supervision.gate_cuts(TAU), strict=True)})


def cuts(spark, d) -> DataFrame:
    return kept(spark, d, "cuts", lambda: cuts_of(market(spark, d)))


def scored(spark, d) -> DataFrame:
    """Decisions on days with a market state, with that state, the label and the score of the sizing check."""
    return kept(spark, d, "scored", lambda: recursions.sizing_anomaly(bridge.decisions(spark, d).join(market(spark, d), ["ticker", "date"])))


def supervised(spark, d, mode: str = "override", **options) -> DataFrame:
    """The daily table: decisions, states, checks by calibrated cuts, and what the supervisor makes of them."""
    rows = scored(spark, d).join(cuts(spark, d), "ticker")
    columns = {x: supervision.cut_columns(x) for x in ("ram", "psa", "gso")}
    return supervision.supervise(rows, mode, cuts=columns, **({"variant": "C"} | options))


BEST_SQL = f"""os AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, CASE WHEN calm >= crisis THEN 1 ELSE -1 END * least(1, 0.10::DOUBLE / sigma) AS x FROM ms WHERE date <= DATE '{CALIBRATION_END}'),
 {points_sql('os', 'ob')}, og AS (SELECT ticker, round(cp, 9) AS g FROM ob WHERE i >= 7)"""
MASTER_SQL = f"""{FEATURES_SQL}, sd AS (SELECT d.ticker, d.date, d.size, d.confidence, d.action, ms.r, ms.r_next, ms.sigma, ms.calm, ms.stress, ms.crisis, row_number() OVER (PARTITION BY d.ticker ORDER BY d.date) AS i FROM dec d JOIN ms USING (ticker, date)),
 s AS (SELECT ticker, i, size AS x FROM sd), {points_sql('s')},
 sc AS (SELECT sd.*, CASE WHEN sd.i >= 7 THEN round(b.cp, 9) ELSE 0 END AS psa, sd.i >= 7 AS ready, least(1, 0.10::DOUBLE / sigma) AS bound FROM sd JOIN b USING (ticker, i)),
 {BEST_SQL}, pc AS (SELECT ticker, quantile_cont(g, 0.95) AS p1, quantile_cont(g, 0.99) AS p2, max(g) AS p3 FROM og GROUP BY ticker),
 gc AS (SELECT ticker, quantile_cont(g, 0.95) AS g1, quantile_cont(g, 0.99) AS g2, max(g) AS g3 FROM (SELECT ticker, round(greatest(0, 1 - least(1, 0.10::DOUBLE / sigma)) / greatest(least(1, 0.10::DOUBLE / sigma), 0.001::DOUBLE), 9) AS g FROM ms WHERE date <= DATE '{CALIBRATION_END}') GROUP BY ticker),
 d0 AS (SELECT sc.*, CASE WHEN abs(size) < 1e-9 THEN 0 WHEN size < 0 THEN calm ELSE crisis END AS ram, greatest(0, abs(size) - bound) / greatest(bound, 0.001::DOUBLE) AS gso, coalesce(p1, 0.2) AS p1, coalesce(p2, 0.4) AS p2, coalesce(p3, 0.7) AS p3, coalesce(g1, 0.2) AS g1, coalesce(g2, 0.4) AS g2, coalesce(g3, 0.7) AS g3 FROM sc LEFT JOIN pc USING (ticker) LEFT JOIN gc USING (ticker)),
 det AS (SELECT *, {SEVERITY('ram', 0.25, 0.5, 0.7)} AS ro, {SEVERITY('gso', 'g1', 'g2', 'g3')} AS go, CASE WHEN ready THEN {SEVERITY('psa', 'p1', 'p2', 'p3')} ELSE 0 END AS po, sign(size) * least(abs(size), bound) AS bounded, CASE WHEN calm >= crisis THEN 1 ELSE -1 END AS rs, greatest(calm, crisis) AS pd FROM d0),
 q AS (SELECT *, {MODES['C'][0]} AS final FROM det)"""


@query(f", {MASTER_SQL} SELECT ticker, date, action, {R('size')} AS size, {NAMES('ro')} AS ram_severity, {NAMES('po')} AS psa_severity, {NAMES('go')} AS gso_severity, CASE WHEN abs(final) < 1e-9 THEN 'hold' WHEN final > 0 THEN 'long' ELSE 'short' END AS final_action, {R('final')} AS final_size, go >= 2 OR ro >= 2 OR po = 3 AS was_intervened, {R('r_next')} AS r_next FROM q")
def q1_master_table(spark, d):
    """Daily supervision: volatility path, regimes, change points, checks by calibrated cuts, override, and the label, in one table."""
    out = supervised(spark, d)
    return out.select("ticker", "date", "action", *r6(size=F.col("size")), "ram_severity", "psa_severity", "gso_severity", "final_action", *r6(final_size=F.col("final_size")), "was_intervened", *r6(r_next=F.col("r_next")))


@query(f", {FEATURES_SQL}, x AS (SELECT ticker, round(greatest(0, 1 - least(1, 0.10::DOUBLE / sigma)) / greatest(least(1, 0.10::DOUBLE / sigma), 0.001::DOUBLE), 9) AS g FROM ms WHERE date <= DATE '{CALIBRATION_END}') SELECT ticker, " + ", ".join(f"{R(f'quantile_cont(g, {p / 100})')} AS p{p}" for p in PERCENTS) + f", {R('max(g)')} AS top, count(*) AS n FROM x GROUP BY ticker")
def q13_gso_calibration(spark, d):
    """Percentiles of the volatility scores of an agent that is all in, over calibration days."""
    score = supervision.gso_score(F.lit(1.0), supervision.gso_bound(F.col("sigma")))
    return calibration(market(spark, d)).select("ticker", F.round(score, 9).alias("g")).groupBy("ticker").agg(*r6(**{f"p{p}": F.percentile("g", F.lit(p / 100)) for p in PERCENTS}, top=F.max("g")), F.count("*").alias("n"))


@query(f", {FEATURES_SQL}, {BEST_SQL} SELECT ticker, " + ", ".join(f"{R(f'quantile_cont(g, {p / 100})')} AS p{p}" for p in PERCENTS) + f", {R('max(g)')} AS top, count(*) AS n FROM og GROUP BY ticker")
def q13_psa_calibration(spark, d):
    """Percentiles of the sizing scores of the best sizing that regimes and volatility give, over calibration days."""
    got = sizing_scores(market(spark, d))
    return got.groupBy("ticker").agg(*r6(**{f"p{p}": F.percentile("psa", F.lit(p / 100)) for p in PERCENTS}, top=F.max("psa")), F.count("*").alias("n"))


@query(f", {DET_SQL}, p AS (SELECT ticker, quantile_cont(ram, 0.75) AS low, quantile_cont(ram, 0.90) AS medium, greatest(quantile_cont(ram, 0.99), quantile_cont(ram, 0.90)) AS high FROM det WHERE date <= DATE '{CALIBRATION_END}' GROUP BY ticker) SELECT ticker, {R('any_value(low)')} AS low, {R('any_value(medium)')} AS medium, {R('any_value(high)')} AS high, count_if(ram >= high) AS n_high, count_if(ram >= medium AND ram < high) AS n_medium, count_if(ram >= low AND ram < medium) AS n_low FROM det JOIN p USING (ticker) GROUP BY ticker")
def d7_regime_cuts(spark, d):
    """The regime check's cuts by percentiles of its scores on calibration days, and how often each severity then comes up."""
    df = detected(spark, d)
    cuts = supervision.calibrated_cuts(calibration(df).select("ticker", F.lit("ram").alias("detector"), F.col("ram").alias("score")))
    rows = df.select("ticker", "ram").join(cuts, "ticker").withColumn("level", supervision.severity(F.col("ram"), supervision.cut_columns("ram")))
    counts = {f"n_{x}": F.count_if(F.col("level") == x) for x in ("high", "medium", "low")}
    return rows.groupBy("ticker").agg(*r6(low=F.first("ram_low"), medium=F.first("ram_medium"), high=F.first("ram_high")), *[c.alias(n) for n, c in counts.items()])


FLAGS = {"all": {"ram", "psa", "gso"}, "no_ram": {"psa", "gso"}, "no_psa": {"ram", "gso"}, "no_gso": {"ram", "psa"}, "ram_only": {"ram"}, "none": set()}
_FLAG_SQL = {n: (f"CASE WHEN {'po = 3' if 'psa' in on else 'false'} THEN 0.5 ELSE 1 END * CASE WHEN {'ro >= 2' if 'ram' in on else 'false'} THEN rs * bound ELSE {ONE} END", f"go >= 2{' OR ro >= 2' if 'ram' in on else ''}{' OR po = 3' if 'psa' in on else ''}") for n, on in FLAGS.items()}


@query(f", {DET_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS enabled, ticker, count(*) AS n, count_if({t}) AS touched, {R(f'sum(({f}) * r_next)')} AS pnl FROM det WHERE r_next IS NOT NULL GROUP BY ticker" for n, (f, t) in _FLAG_SQL.items()))
def i8_detector_ablation(spark, d):
    """Override with some of the checks off. The volatility check bounds sizes in this mode even where it is off."""
    base, out = detected(spark, d).where("r_next is not null").withColumns({"psa_ready": F.lit(True), "map_run_length": F.lit(0)}), None
    for name, on in FLAGS.items():
        one = supervision.supervise(base, "override", "C", enabled=on).groupBy("ticker").agg(F.count("*").alias("n"), F.count_if("was_intervened").alias("touched"), *r6(pnl=F.sum(F.col("final_size") * F.col("r_next"))))
        one = one.select(F.lit(name).alias("enabled"), "ticker", "n", "touched", "pnl")
        out = one if out is None else out.unionByName(one)
    return out


@query(f", {DET_SQL} SELECT low, medium, high, count_if(ram >= low) AS n_low, count_if(ram >= medium) AS n_medium, count_if(ram >= high) AS n_high FROM det, (SELECT 0.25::DOUBLE AS low, 0.5::DOUBLE AS medium, 0.7::DOUBLE AS high) GROUP BY low, medium, high")
def c5_half_gate(spark, d):
    """The gate without parameters, one half, and the cuts that follow from it."""
    low, medium, high = supervision.gate_cuts(TAU)
    return detected(spark, d).agg(*[F.count_if(F.col("ram") >= v).alias(f"n_{n}") for n, v in (("low", low), ("medium", medium), ("high", high))]).select(F.lit(low).alias("low"), F.lit(medium).alias("medium"), F.lit(high).alias("high"), "n_low", "n_medium", "n_high")


def reliability(spark, d) -> DataFrame:
    """ticker, date, conf, right: whether the likelier of calm and crisis has the sign of the next return."""
    right = (F.when(F.col("calm") >= F.col("crisis"), 1.0).otherwise(-1.0) == F.signum("r_next")).cast("double")
    return labelled(spark, d).where(VALID).select("ticker", "date", F.greatest("calm", "crisis").alias("conf"), right.alias("right"))


@query()
def c3_gate(spark, d):
    """Each ticker's gate by 1000 stationary resamples, a hundred a task."""
    return inference.gates(reliability(spark, d), "ticker", 1000)


@query()
def c4_isotonic_gate(spark, d):
    return inference.isotonic_gates(reliability(spark, d), "ticker")


def paired(spark, d) -> DataFrame:
    """ticker, date, net returns of the agent, of the override, and whether each had the direction (null: no move)."""
    df = supervised(spark, d).select("ticker", "date", "r", "r_next", F.col("size").alias("a"), F.col("final_size").alias("b"))
    return df.withColumns({f"net_{x}": net(F.col(x), F.col("r")) for x in ("a", "b")} | {f"right_{x}": F.when(F.expr(VALID), (F.signum(x) == F.signum("r_next")).cast("double")) for x in ("a", "b")})


def net(weight: Column, r: Column, *keys: str, cost: float = 1e-4) -> Column:
    """Net return of a weight that acts one row later, within keys (ticker first) in date order."""
    order = W.partitionBy("ticker", *keys).orderBy("date")
    before, then = (F.coalesce(F.lag(weight, k).over(order), F.lit(0.0)) for k in (1, 2))
    return before * r - cost * F.abs(before - then)


@query()
def t1_t11_tests(spark, d):
    """Of each ticker's net returns and of override against agent: deflated Sharpe with skew and kurtosis, sign test with its exact
    interval, McNemar, equivalence, bootstrap intervals (independent and stationary), difference of Sharpe ratios, block permutation.
    A hundred replicates of a ticker are a task's work, a thousand of the sign flips."""

    def tests(rows: pd.DataFrame) -> dict:
        x, fine = rows["net_b"].dropna().to_numpy(dtype=float), rows.dropna(subset=["right_a", "right_b"])
        n, mean, sd = len(x), float(x.mean()), float(x.std(ddof=1))
        z = (x - mean) / sd if sd > 0 else np.zeros(n)
        a, b = fine["right_a"].to_numpy(dtype=float), fine["right_b"].to_numpy(dtype=float)
        hits, total = int(b.sum()), len(b)
        won, lost = int(((a == 1) & (b == 0)).sum()), int(((a == 0) & (b == 1)).sum())
        gap = (rows["net_b"] - rows["net_a"]).dropna().to_numpy(dtype=float)
        low, high = inference.sign_interval(hits, total)
        return {
            "n": n, "deflated": inference.deflated_sharpe(mean / sd if sd > 0 else 0.0, 10, n, float((z**3).mean()), float((z**4).mean())),
            "sign_p": special.binomial_two_sided(hits, total), "low": low, "high": high, "mcnemar_p": inference.mcnemar_p(won, lost), "greater_p": special.binomial_tail(hits, total),
            "tost_p": inference.tost_p(float(gap.mean()), float(gap.std(ddof=1)), len(gap), 0.5 / 252**0.5 * float(gap.std(ddof=1))),
        }

    numbers = ("deflated", "sign_p", "low", "high", "mcnemar_p", "greater_p", "tost_p")
    rows = paired(spark, d).withColumn("right_gap", F.col("right_a") - F.col("right_b"))
    draws = {
        "mean": inference.resampled(np.mean, "net_b", block=0.0), "block": inference.resampled(np.mean, "net_b"),
        "sharpe": inference.resampled(inference.sharpe_difference, "net_b", "net_a"),
    }
    spans = inference.intervals(inference.replicated(rows, "ticker", draws, 1000), "ticker")
    of = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    wide = spans.groupBy("ticker").agg(*[of(n, c).alias(f"{n}_{c}") for n in draws for c in ("low", "high")], of("sharpe", "point").alias("sharpe_gap"))
    flips = inference.intervals(inference.replicated(rows, "ticker", {"flip": inference.flipped("right_gap")}, 10_000, 1000), "ticker").select("ticker", F.col("mean").alias("permutation_p"))
    scalars = inference.by_key(rows, "ticker", tests, "n long, " + ", ".join(f"{c} double" for c in numbers))
    return scalars.join(wide, "ticker").join(flips, "ticker", "left")


@query()
def t5_diebold_mariano(spark, d):
    """Agent against override, by daily losses and two lags."""
    return inference.diebold_mariano(paired(spark, d).select(F.col("ticker").alias("key"), "date", (F.col("net_a") - F.col("net_b")).alias("d")), 3)


def meta_rows(spark, d) -> DataFrame:
    """The meta-learner's 22 features, label and row number of each labelled day of a ticker."""
    return kept(spark, d, "meta_rows", lambda: _meta_rows(spark, d))


def _meta_rows(spark, d) -> DataFrame:
    people = f14_persona_features(spark, d)
    rows = supervised(spark, d).where(VALID).select("ticker", "date", "r", "r_next", "final_size", *[F.col(a).alias(b) for a, b in zip(("ram", "psa", "gso", "calm", "stress", "crisis", "sigma"), MARKET_FEATURES, strict=True)])
    rows = rows.join(people, ["ticker", "date"])
    return rows.withColumns({"row_pos": (F.row_number().over(by()) - 1).cast("long"), "label": (F.col("r_next") > 0).cast("double"), "t1": F.coalesce(F.lead("date").over(by()), "date")})


def purged(rows: DataFrame) -> DataFrame:
    return folds.purged_by(rows.select("ticker", "row_pos", F.col("date").alias("t0"), "t1"), "ticker")


INPUTS = PERSONA_FEATURES + MARKET_FEATURES


def predictions(spark, d) -> DataFrame:
    """The meta-learner's predictions for the tested rows of each purged fold, with Shapley values: fitted once for all queries."""
    rows = meta_rows(spark, d)
    return kept(spark, d, "predictions", lambda: learning.fold_predictions(rows, purged(rows), INPUTS, "ticker", importance=True))


@query()
def v6_meta_learner(spark, d):
    """Out-of-fold probabilities of each ticker's next direction, and the position that they give."""
    got = learning.out_of_fold(predictions(spark, d), "ticker")
    return got.select("ticker", "row_pos", "p", F.signum(F.col("p") - 0.5).alias("position"), (2 * F.col("p") - 1).alias("graded"))


@query()
def v7_f16_importance(spark, d):
    """Mean size of each feature's Shapley value over the out-of-fold rows, how far it moves their predictions, and what kind it is."""
    got = learning.importance(predictions(spark, d), INPUTS, "ticker")
    return got.withColumn("family", text.family(F.col("feature")))


@query()
def v4_leaderboard(spark, d):
    """Candidates by the area under the curve over out-of-fold rows: five stretches with an embargo, five folds dealt without regard to
    time, which leak, and how far a candidate's area is from that of the stretches."""
    rows = meta_rows(spark, d)
    out = None
    for name, dealt in (("purged", folds.contiguous(rows.select("ticker", "date"), "ticker", "date", 5, 5)), ("shuffled", folds.shuffled(rows.select("ticker", "date"), "ticker", "date", 5))):
        board = learning.leaderboard_by(rows, folds.roles(dealt, "ticker", 5), INPUTS, "ticker").select(F.lit(name).alias("folds"), "*")
        out = board if out is None else out.unionByName(board)
    ground = F.max(F.when(F.col("folds") == "purged", F.col("auc"))).over(W.partitionBy("ticker", "kind"))
    return out.withColumn("bias", F.col("auc") - ground)


@query()
def v4_search(spark, d):
    """Each ticker's best of a grid of candidates by successive halving over purged stretches, forty fits at most."""
    rows = meta_rows(spark, d)
    cut = folds.roles(folds.contiguous(rows.select("ticker", "date"), "ticker", "date", 5, 5), "ticker", 5)
    return learning.search_by(rows, cut, INPUTS, "ticker")


def performance(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, sharpe, accuracy, mcc, hit_rate, turnover, equity, n of rows (ticker, keys, date, r, r_next, w)."""
    order = W.partitionBy("ticker", *keys).orderBy("date")
    df = rows.withColumns({"net": net(F.col("w"), F.col("r"), *keys), "turned": F.abs(F.col("w") - F.lag("w").over(order)), "valid": F.expr(f"coalesce({VALID}, false)")})
    right = F.when(F.col("valid"), (F.signum("w") == F.signum("r_next")).cast("double"))
    active = F.col("valid") & (F.col("w") != 0)
    return df.groupBy("ticker", *keys).agg(
        backtest.sharpe(F.col("net")).alias("sharpe"), F.avg(right).alias("accuracy"), matthews(F.when(active, F.col("w") > 0), F.when(active, F.col("r_next") > 0)).alias("mcc"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.avg("turned").alias("turnover"), (1000 * F.product(1 + F.col("net"))).alias("equity"), F.count_if("valid").alias("n"),
    )


@query()
def v8_agent_only(spark, d):
    """The meta-learner with all features and with the agent's own alone: Sharpe and log loss."""
    rows, out = meta_rows(spark, d), None
    for name, got in (("all", predictions(spark, d)), ("agent", learning.fold_predictions(rows, purged(rows), PERSONA_FEATURES, "ticker"))):
        one = got.groupBy("ticker", "row_pos").agg(F.avg("p").alias("p"), F.first("y").alias("y")).withColumn("inputs", F.lit(name))
        out = one if out is None else out.unionByName(one)
    q = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    out = out.withColumns({"w": F.signum(F.col("p") - 0.5), "loss": -F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))})
    long = out.join(rows.select("ticker", "row_pos", "date", "r", "r_next"), ["ticker", "row_pos"])
    return performance(long, "inputs").select("ticker", "inputs", "sharpe", "accuracy", "n").join(long.groupBy("ticker", "inputs").agg(F.avg("loss").alias("log_loss")), ["ticker", "inputs"])


_STUMP_VARS = ["calm", "stress", "crisis", "ram", "size", "confidence"]


@query()
def m32_stumps(spark, d):
    """The best single split of each variable of a ticker, against always predicting the commoner direction."""
    df = detected(spark, d).where(VALID).withColumn("up", (F.col("r_next") > 0).cast("int"))
    return learning.stumps(df, "ticker", _STUMP_VARS)


def _snapshots(spark, d) -> DataFrame:
    """The first priority class stands for the index, the second for implied volatility, the third for the rate, the rest for sectors."""
    return macro.snapshots(bridge.bars(spark, d), bridge.decisions(spark, d), "1-URGENT", "2-HIGH", "3-MEDIUM", ["4-NOT SPECIFIED", "5-LOW"])


_STATES_SQL = f"""st AS (SELECT ticker, date, close, close / lag(close, 1) {WIN} - 1 AS ret_1d, close / lag(close, 21) {WIN} - 1 AS ret_1m, close / lag(close, 63) {WIN} - 1 AS ret_3m,
 first_value(close) OVER (PARTITION BY ticker, year(date) ORDER BY date) AS first, list_sum(list_transform(h, lambda x: CASE WHEN x <= close THEN 1 ELSE 0 END)) / len(h)::DOUBLE AS percentile FROM (SELECT *, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING) AS h FROM daily)),
 asked AS (SELECT DISTINCT date FROM dec),
 seen AS (SELECT a.ticker, a.date, st.close, st.ret_1d, st.ret_1m, st.ret_3m, st.percentile, CASE WHEN year(st.date) = year(a.date) THEN st.close / st.first - 1 END AS ret_ytd FROM (SELECT t.ticker, asked.date FROM asked, (SELECT DISTINCT ticker FROM daily) t) a ASOF JOIN st ON a.ticker = st.ticker AND a.date >= st.date),
 mk AS (SELECT i.date, i.close AS i_close, i.ret_1m AS i_1m, i.ret_3m AS i_3m, i.ret_ytd AS i_ytd, k.close AS k_close, k.ret_1d AS k_1d, k.percentile AS k_pct, t.close AS t_close, t.ret_1d AS t_1d FROM seen i JOIN seen k ON k.date = i.date AND k.ticker = '2-HIGH' JOIN seen t ON t.date = i.date AND t.ticker = '3-MEDIUM' WHERE i.ticker = '1-URGENT'),
 ro AS (SELECT mk.date, s.ticker AS sector, s.ret_1m - mk.i_1m AS excess, row_number() OVER (PARTITION BY mk.date ORDER BY round(s.ret_1m - mk.i_1m, 9) DESC, s.ticker) AS k FROM mk JOIN seen s ON s.date = mk.date AND s.ticker IN ('4-NOT SPECIFIED', '5-LOW') WHERE s.ret_1m - mk.i_1m IS NOT NULL)"""


@query(f", {_STATES_SQL} SELECT d.ticker, d.date, {R('i_close')} AS index_close, {R('i_1m')} AS index_ret_1m, {R('i_3m')} AS index_ret_3m, {R('i_ytd')} AS index_ret_ytd, {R('k_close')} AS risk_close, {R('k_1d')} AS risk_ret_1d, {R('k_pct')} AS risk_percentile, {R('t_close')} AS rate_close, {R('t_1d')} AS rate_ret_1d, {R('o.close')} AS own_close, {R('o.ret_1m')} AS own_ret_1m, {R('o.ret_ytd')} AS own_ret_ytd, ro.sector AS leader, {R('ro.excess')} AS leader_excess FROM dec d JOIN mk USING (date) JOIN seen o ON o.ticker = d.ticker AND o.date = d.date LEFT JOIN ro ON ro.date = d.date AND ro.k = 1")
def x5_snapshots(spark, d):
    """The market snapshot of each decision, flattened; of the sectors the strongest."""
    names = ("index_close", "index_ret_1m", "index_ret_3m", "index_ret_ytd", "risk_close", "risk_ret_1d", "risk_percentile", "rate_close", "rate_ret_1d", "own_close", "own_ret_1m", "own_ret_ytd")
    first = F.get("rotation", F.lit(0))
    return _snapshots(spark, d).select("ticker", "date", *r6(**{n: F.col(n) for n in names}), first["sector"].alias("leader"), *r6(leader_excess=first["excess"]))


@query()
def f20_snapshot_text(spark, d):
    return _snapshots(spark, d).select("ticker", "date", text.snapshot_text("1-URGENT").alias("text"))


@query(f", {FEATURES_SQL} SELECT ticker, date, 'State of the market today, as information and not as advice:' || chr(10) || '- Regime probabilities: calm ' || printf('%.2f', calm) || ', stress ' || printf('%.2f', stress) || ', crisis ' || printf('%.2f', crisis) || ' (most likely path: ?).' || chr(10) || '- Volatility forecast, a year: ' || printf('%.1f%%', sigma * 100) || '.' || chr(10) || '- Largest position within a volatility budget of 10% a year: ' || printf('%.2f', least(1, 0.10 / sigma)) || '.' AS text FROM (SELECT ticker, date, round(calm, 6) + 1e-9 AS calm, round(stress, 6) + 1e-9 AS stress, round(crisis, 6) + 1e-9 AS crisis, round(sigma, 6) + 1e-9 AS sigma FROM ms)")
def f21_statistics_text(spark, d):
    """The day's regime and volatility in neutral words. Numbers are rounded first, and moved off ties, so that engines agree on them."""
    c = {n: F.round(n, 6) + 1e-9 for n in ("calm", "stress", "crisis", "sigma")}
    return market(spark, d).select("ticker", "date", text.statistics_text(c["calm"], c["stress"], c["crisis"], F.lit(None), c["sigma"], F.least(F.lit(1.0), 0.10 / c["sigma"])).alias("text"))


def sweep(spark, d) -> DataFrame:
    """Override with one check's cut moved to a percentile of its calibration scores; the row `base` has the calibrated cuts."""
    rows, states = scored(spark, d), market(spark, d)
    psa = sizing_scores(states).groupBy("ticker").agg(F.percentile("psa", F.array(*[F.lit(p / 100) for p in PERCENTS])).alias("psa_p"))
    all_in = F.round(supervision.gso_score(F.lit(1.0), supervision.gso_bound(F.col("sigma"))), 9)
    gso = calibration(states).groupBy("ticker").agg(F.percentile(all_in, F.array(*[F.lit(p / 100) for p in PERCENTS])).alias("gso_p"), F.max(all_in).alias("gso_max"))
    df = rows.join(cuts(spark, d), "ticker").join(psa, "ticker", "left").join(gso, "ticker", "left")
    points = [F.struct(F.lit("base").alias("moved"), F.lit(0).alias("percent"))] + [F.struct(F.lit(x).alias("moved"), F.lit(p).alias("percent")) for x in ("psa", "gso") for p in PERCENTS]
    df = df.select("*", F.explode(F.array(*points)).alias("g")).select("*", "g.*").drop("g")
    place = F.array_position(F.array(*map(F.lit, PERCENTS)), F.col("percent")).cast("int")
    at = {x: F.when(F.col("moved") == x, F.element_at(f"{x}_p", F.when(place > 0, place).otherwise(1))) for x in ("psa", "gso")}
    df = df.withColumns({"psa_at": at["psa"], "gso_at": at["gso"]})
    df = df.withColumns({
        "psa_low": F.when(F.col("psa_at").isNotNull(), 0.0).otherwise(F.col("psa_low")), "psa_medium": F.coalesce("psa_at", "psa_medium"), "psa_high": F.coalesce("psa_at", "psa_high"),
        "gso_low": F.coalesce("gso_at", "gso_low"), "gso_medium": F.coalesce("gso_at", "gso_medium"), "gso_high": F.when(F.col("gso_at").isNotNull(), F.col("gso_max")).otherwise(F.col("gso_high")),
    })
    return supervision.supervise(df, "override", "C", cuts={x: supervision.cut_columns(x) for x in ("ram", "psa", "gso")})


def _discordant(pair: DataFrame, other: str, *keys: str) -> DataFrame:
    """keys, b (the point is right, the other is not), c, p and the gain in accuracy: {other}_b, ... of rows with right and {other}."""
    out = pair.groupBy(*keys).agg(
        F.count_if(F.col("right") & ~F.col(other)).alias(f"{other}_b"), F.count_if(~F.col("right") & F.col(other)).alias(f"{other}_c"),
        F.avg(F.col("right").cast("double") - F.col(other).cast("double")).alias(f"{other}_gain"),
    )
    return out.withColumn(f"{other}_p", inference.mcnemar(f"{other}_b", f"{other}_c"))


@query()
def q3_t12_threshold_sensitivity(spark, d):
    """Five percentiles for each of two checks, against the calibrated cuts (base) and the agent: performance, interventions, McNemar,
    and whether the point refutes that these checks leave the direction alone. At the least percentile, the mean difference of
    net returns from the base with its stationary interval of 2000 resamples, and the change of the Sharpe ratio."""
    keys = ["ticker", "moved", "percent"]
    rows = sweep(spark, d)
    fired = F.when(F.col("moved") == "psa", F.col("psa_severity") == "high").otherwise(F.col("gso_severity").isin("medium", "high"))
    rows = rows.select(*keys, "date", "r", "r_next", F.col("final_size").alias("w"), "size", fired.alias("fired"))
    right = lambda c: F.when(F.expr(VALID), F.signum(c) == F.signum("r_next"))
    marked = rows.withColumns({"net": net(F.col("w"), F.col("r"), "moved", "percent"), "right": right("w"), "agent": right("size")})
    base = marked.where("moved = 'base'").select("ticker", "date", F.col("right").alias("base"), F.col("net").alias("base_net"))
    pair = marked.where("moved <> 'base'").join(base, ["ticker", "date"])
    out = _discordant(pair, "base", *keys).join(_discordant(pair, "agent", *keys), keys).join(pair.groupBy(*keys).agg(F.count_if("fired").alias("fired")), keys)
    out = out.withColumn("refutes", inference.refutes(F.col("base_gain"), F.col("base_p"), F.col("base_b"), F.col("base_c")))
    least = pair.where(F.col("percent") == min(PERCENTS)).select(F.concat_ws("|", "ticker", "moved").alias("key"), "date", (F.col("net") - F.col("base_net")).alias("gap"))
    spans = inference.intervals(inference.replicated(least, "key", {"gap": inference.resampled(np.mean, "gap")}, 2000, 200), "key")
    spans = spans.withColumn("x", F.split("key", "[|]")).select(F.col("x")[0].alias("ticker"), F.col("x")[1].alias("moved"), F.lit(min(PERCENTS)).alias("percent"), F.col("point").alias("mean_gap"), "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("without_zero"))
    figures = performance(rows, "moved", "percent")
    ground = figures.where("moved = 'base'").select("ticker", F.col("sharpe").alias("base_sharpe"))
    out = out.join(spans, keys, "left").join(figures, keys).join(ground, "ticker").withColumn("sharpe_change", F.col("sharpe") - F.col("base_sharpe"))
    return out.withColumn("most_gain", F.max(F.abs("base_gain")).over(W.partitionBy("ticker")))


KS = (2, 3, 4)


def fitted_regimes(spark, d, ks: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Regime models of the calibration days with the common starts, fitted once for all queries."""
    table = kept(spark, d, "regime_models", lambda: models.fit_regimes(calibration(inputs(spark, d)), KS))
    return table.where(F.col("k").isin(*ks))


def ruled(spark, d, ks: tuple[int, ...], tau: float | None = None) -> DataFrame:
    """by_states() under the fitted models, supervised once for all queries."""
    return kept(spark, d, f"by_states {tau}", lambda: by_states(spark, d, KS, tau=tau)).where(F.col("k").isin(*ks))


def by_states(spark, d, ks: tuple[int, ...] = (2, 3), fitted: DataFrame | None = None, *keep: str, tau: float | None = None) -> DataFrame:
    """Test days supervised under fitted models, one set for each number of states (and keep): override C, regime gate by isotonic
    calibration or tau, other cuts calibrated. Columns: ticker, k, keep, date, r, r_next, size, final_size, was_intervened, tau, ..."""
    rows = inputs(spark, d)
    fitted = fitted_regimes(spark, d, ks) if fitted is None else fitted
    gamma = models.apply_regimes(rows, fitted, *keep).join(rows.select("ticker", "date", "r", "r_next"), ["ticker", "date"])
    returns = features(spark, d).where("r is not null")
    sigma = models.apply_volatility(returns.where(F.col("date") > CALIBRATION_END), kept(spark, d, "volatility_models", lambda: models.fit_volatility(calibration(returns))))
    days = recursions.sizing_anomaly(bridge.decisions(spark, d).join(sigma, ["ticker", "date"]))
    limits = cuts(spark, d).drop("ram_low", "ram_medium", "ram_high")
    gates = models.calibrate_gates(calibration(gamma), "ticker", "k", *keep) if tau is None else gamma.select("ticker", "k", *keep).distinct().withColumn("tau", F.lit(tau))
    full = days.join(gamma, ["ticker", "date"]).join(limits, "ticker").join(gates, ["ticker", "k", *keep])
    chosen = {"ram": supervision.gate_cuts(F.col("tau"))} | {x: supervision.cut_columns(x) for x in ("psa", "gso")}
    return supervision.supervise(full, "override", "C", cuts=chosen)


def outcome(rows: DataFrame, *keys: str) -> DataFrame:
    """performance() of the supervised position, with the interventions."""
    rows = rows.withColumn("w", F.col("final_size"))
    return performance(rows, *keys).join(rows.groupBy("ticker", *keys).agg(F.count_if("was_intervened").alias("touched"), F.first("tau").alias("tau")), ["ticker", *keys])


def against(rows: DataFrame, left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """ticker, keys, b, c, mcnemar_p, dm, dm_p: left against right (ticker, keys, date, w, r, r_next), day by day."""
    def marked(df: DataFrame, x: str) -> DataFrame:
        return df.select("ticker", *keys, "date", net(F.col("w"), F.col("r"), *keys).alias(f"net_{x}"), F.when(F.expr(VALID), F.signum("w") == F.signum("r_next")).alias(f"right_{x}"))

    pair = marked(left, "a").join(marked(right, "b"), ["ticker", *keys, "date"])
    counts = pair.groupBy("ticker", *keys).agg(F.count_if(F.col("right_a") & ~F.col("right_b")).alias("b"), F.count_if(~F.col("right_a") & F.col("right_b")).alias("c"))
    key = F.concat_ws("|", "ticker", *keys)
    dm = inference.diebold_mariano(pair.select(key.alias("key"), "date", (F.col("net_b") - F.col("net_a")).alias("d")))
    return counts.withColumns({"mcnemar_p": inference.mcnemar("b", "c"), "key": key}).join(dm.select("key", "dm", F.col("p").alias("dm_p")), "key").drop("key")


@query()
def st4_st8_models(spark, d):
    """Fitted regime models of two and three states: start, transitions, means, covariances, scaling, state order applied."""
    return fitted_regimes(spark, d)


@query()
def st3_volatility_models(spark, d):
    return models.fit_volatility(calibration(features(spark, d)))


@query()
def q4_two_or_three_states(spark, d):
    """Each ticker under two and three states side by side."""
    rows = ruled(spark, d, (2, 3)).withColumn("w", F.col("final_size"))
    three, two = (rows.where(F.col("k") == k).drop("k") for k in (3, 2))
    result = outcome(rows, "k").withColumn("k", F.concat(F.lit("k"), F.col("k").cast("string")))
    wide = result.groupBy("ticker").pivot("k", ["k2", "k3"]).agg(F.first("sharpe").alias("sharpe"), F.first("accuracy").alias("accuracy"), F.first("touched").alias("touched"), F.first("tau").alias("tau"))
    out = wide.join(against(rows, three, two), "ticker")
    return out.withColumn("two_better", F.col("k2_sharpe") > F.col("k3_sharpe"))


def ex_ante(rows: DataFrame, *keys: str) -> DataFrame:
    """ticker, keys, at_gate (accuracy of regime calls at or over tau on calibration days), fire_share."""
    fine = rows.where("r_next is not null")
    fired = F.greatest("calm", "crisis") >= F.col("tau")
    right = F.when(F.col("calm") >= F.col("crisis"), F.col("r_next") > 0).otherwise(F.col("r_next") < 0).cast("double")
    return fine.groupBy("ticker", *keys).agg(F.avg(F.when(fired, right)).alias("at_gate"), F.avg(fired.cast("double")).alias("fire_share"))


def _states_per_ticker(spark, d) -> tuple[DataFrame, DataFrame]:
    """Figures of each ticker and number of states with the chosen and the later best one; net returns by ticker, k and day."""
    rows = inputs(spark, d)
    gamma = calibration(models.apply_regimes(rows, fitted_regimes(spark, d, KS)).join(rows.select("ticker", "date", "r_next"), ["ticker", "date"]))
    before = ex_ante(gamma.join(models.calibrate_gates(gamma, "ticker", "k"), ["ticker", "k"]), "k")
    later = ruled(spark, d, KS)
    after = outcome(later, "k").select("ticker", "k", "sharpe", "accuracy", "touched", "tau")
    both = before.join(after, ["ticker", "k"])
    chosen = models.best_k(both, "at_gate", share="fire_share").withColumnRenamed("k", "chosen")
    best = models.best_k(both, "sharpe", tie=0.0).withColumnRenamed("k", "best_later")
    out = both.join(chosen, "ticker", "left").join(best, "ticker", "left").withColumn("match", F.col("chosen") == F.col("best_later"))
    return out, later.select("ticker", "k", "date", net(F.col("final_size"), F.col("r"), "k").alias("net"))


@query()
def q5_m23_states_per_ticker(spark, d):
    """The number of states of each ticker by calibration accuracy at the gate (a twentieth of the days must fire; the least among
    equals), against the best Sharpe on test days, with the panel's aggregates."""
    out, _ = _states_per_ticker(spark, d)
    whole = W.partitionBy("k")  # a row a ticker and k
    return out.withColumns({"mean_sharpe": F.avg("sharpe").over(whole), "median_sharpe": F.median("sharpe").over(whole)})


@query()
def q5_panel(spark, d):
    """One row: each ticker's own number of states against three for all. How often the choice was the later best, mean and median Sharpe,
    and Diebold-Mariano on the daily losses of all tickers, stacked and paired by their place."""
    table, nets = _states_per_ticker(spark, d)
    table = written(table)
    own, three = table.where("k = chosen"), table.where("k = 3")
    counts = [F.count_if(F.col("chosen") == k).alias(f"chosen_{k}") for k in KS]
    figures = own.agg(F.count("*").alias("tickers"), F.count_if("match").alias("matches"), *counts, F.avg("sharpe").alias("mean_chosen"), F.median("sharpe").alias("median_chosen"))
    fixed = three.agg(F.avg("sharpe").alias("mean_three"), F.median("sharpe").alias("median_three"))
    nets = written(nets.where("net is not null"))
    side = nets.join(own.select("ticker", F.col("chosen").alias("k")), ["ticker", "k"]).select("ticker", "date", "net")
    gap = stacked(side, nets.where("k = 3").select("ticker", "date", "net"))
    tested = inference.diebold_mariano(gap).select(F.col("n").alias("days"), "dm", F.col("p").alias("dm_p"))
    return figures.crossJoin(F.broadcast(fixed)).crossJoin(F.broadcast(tested))  # one row each


def stacked(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, date, d: loss of left less loss of right (ticker, date, net), each stacked by ticker and date, paired by place as far as
    the shorter one goes. date is the place's day in left."""
    a, b = (scans.numbered(x, "ticker", "date") for x in (left, right))
    pair = a.join(b.select("at", F.col("net").alias("other")), "at")
    return pair.select(F.lit("all").alias("key"), "date", (F.col("other") - F.col("net")).alias("d"))


@query()
def c7_q7_heldout(spark, d):
    """Held-out log-likelihood, information criteria and the plateau: the number of states past which less than 0.001 a row is gained."""
    rows = calibration(inputs(spark, d))
    out = models.heldout_loglik(rows).join(models.criteria(fitted_regimes(spark, d)).drop("loglik"), ["ticker", "k"])
    two = F.max(F.when(F.col("k") == 2, F.col("loglik"))).over(W.partitionBy("ticker"))
    three = F.max(F.when(F.col("k") == 3, F.col("loglik"))).over(W.partitionBy("ticker"))
    return out.withColumn("plateau", F.when(three - two > 0.001, 3).otherwise(2)).withColumn("best", F.when(three > two, 3).otherwise(2))


@query()
def m17_durations(spark, d):
    """Occupancy of the Viterbi states on calibration days, expected duration, mean and deviation of returns."""
    rows = calibration(inputs(spark, d))
    fitted = fitted_regimes(spark, d)
    seen = models.apply_regimes(rows, fitted).join(rows.select("ticker", "date", "r"), ["ticker", "date"])
    table = seen.groupBy("ticker", "k", "state").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    table = table.withColumn("occupancy", F.col("n") / F.sum("n").over(W.partitionBy("ticker", "k")))
    return models.transitions(fitted).select("ticker", "k", "state", "stay", "duration").join(table, ["ticker", "k", "state"], "left")


def selection(spark, d) -> DataFrame:
    """ticker, k, sharpe, accuracy, active of the directional criterion on calibration days."""
    return models.directional(calibration(inputs(spark, d)))


@query()
def c8_q8_directional(spark, d):
    """Directional choice of the number of states, and how the gain of the third goes with a ticker's volatility."""
    table = selection(spark, d)
    side = lambda c: [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in (2, 3)]
    wide = table.groupBy("ticker").agg(*side("sharpe"), *side("accuracy"))
    vol = calibration(inputs(spark, d)).groupBy("ticker").agg((F.stddev_samp("r") * 252**0.5).alias("volatility"), (F.avg("r") * 252).alias("drift"))
    out = wide.join(vol, "ticker").withColumn("gain", F.col("sharpe_3") - F.col("sharpe_2")).withColumn("chosen", F.when(F.col("gain") > 0, 3).otherwise(2))
    return out.crossJoin(F.broadcast(inference.spearman(out, "volatility", "gain").select("rho", "p")))  # one row


@query()
def q6_directional_later(spark, d):
    """The directional choice of calibration days, held against test days."""
    chosen = c8_q8_directional(spark, d).select("ticker", "chosen")
    after = outcome(ruled(spark, d, (2, 3), TAU), "k").select("ticker", "k", "sharpe", "accuracy", "touched")
    side = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in (2, 3) for c in ("sharpe", "accuracy", "touched")]
    out = after.groupBy("ticker").agg(*side).join(chosen, "ticker")
    best = F.when(F.col("sharpe_3") > F.col("sharpe_2"), 3).otherwise(2)
    return out.withColumns({"best_later": best, "match": F.col("chosen") == best, "sharpe_chosen": F.when(F.col("chosen") == 3, F.col("sharpe_3")).otherwise(F.col("sharpe_2"))})


BASE_SEEDS = (42, *range(19))


@query()
def q9_seed_stability(spark, d):
    """The result under each of twenty base seeds, a base seed standing for the best of ten starts from it on. Each start is fitted once."""
    return kept(spark, d, "seeds", lambda: _seeds(spark, d))


def _seeds(spark, d) -> DataFrame:
    rows = calibration(inputs(spark, d))
    every = tuple(sorted({s + i for s in BASE_SEEDS for i in range(10)}))
    starts = models.regime_starts(rows, (3,), every)
    base = F.explode(F.array(*map(F.lit, BASE_SEEDS))).alias("base")
    names = starts.columns
    mine = starts.select("*", base).where("seed >= base and seed < base + 10")
    fitted = mine.groupBy("ticker", "k", "base").agg(F.max_by(F.struct(*names), F.struct("loglik", -F.col("seed"))).alias("m")).select("base", "m.*")
    got = by_states(spark, d, (3,), fitted, "base").withColumn("w", F.col("final_size"))
    result = outcome(got, "base").select("ticker", "base", "tau", "sharpe", "accuracy", "touched")
    agent = got.withColumn("w", F.col("size"))
    return result.join(against(got, agent, got, "base").select("ticker", "base", "b", "c", "mcnemar_p"), ["ticker", "base"])


@query()
def q9_seed_dispersion(spark, d):
    """Least, median and largest result over the base seeds, and the shares that are significant."""
    each = q9_seed_stability(spark, d)
    span = [f(c).alias(f"{n}_{c}") for c in ("tau", "sharpe", "mcnemar_p") for n, f in (("least", F.min), ("median", F.median), ("most", F.max))]
    shares = [F.avg((F.col("mcnemar_p") < p).cast("double")).alias(f"under_{round(100 * p)}") for p in (0.10, 0.05)]
    return each.groupBy("ticker").agg(F.count("*").alias("seeds"), *span, *shares, F.avg((F.col("sharpe") > 0).cast("double")).alias("positive"))


def learner_rows(spark, d, k: int) -> DataFrame:
    """The meta-learner's rows of the test days under fitted models of k states: meta_rows() with the positions of rule and agent."""
    def make() -> DataFrame:
        rows = ruled(spark, d, (k,), TAU).where(VALID).join(f14_persona_features(spark, d), ["ticker", "date"])
        rows = rows.select("ticker", "k", "date", "r", "r_next", "size", "final_size", *PERSONA_FEATURES, *[F.col(a).alias(b) for a, b in zip(("ram", "psa", "gso", "calm", "stress", "crisis", "sigma"), MARKET_FEATURES, strict=True)])
        return rows.withColumns({"row_pos": (F.row_number().over(by()) - 1).cast("long"), "label": (F.col("r_next") > 0).cast("double"), "t1": F.coalesce(F.lead("date").over(by()), "date")})

    return kept(spark, d, f"learner_rows {k}", make)


def learner_predictions(spark, d, k: int, importance: bool = False) -> DataFrame:
    """predictions() for learner_rows(); with Shapley values only where they are asked for, as those cost as much again."""
    rows = learner_rows(spark, d, k)
    return kept(spark, d, f"learner_predictions {k} {importance}", lambda: learning.fold_predictions(rows, purged(rows), INPUTS, "ticker", importance=importance))


def learned(spark, d, k: int) -> DataFrame:
    """Test days under fitted models with the meta-learner's out-of-fold position (w10) beside the rule's and the agent's."""
    got = learning.out_of_fold(learner_predictions(spark, d, k, k == 2), "ticker")
    return learner_rows(spark, d, k).join(got, ["ticker", "row_pos"]).withColumn("w10", F.signum(F.col("p") - 0.5))


@query()
def q10_meta_against_rule(spark, d):
    """Two states: the meta-learner against the rule and the agent, with equivalence within half a Sharpe unit."""
    rows = learned(spark, d, 2).drop("k")
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(c).alias("w")) for n, c in (("learner", "w10"), ("rule", "final_size"), ("agent", "size"))])).alias("x")
    result = performance(rows.select("ticker", "date", "r", "r_next", parts).select("ticker", "date", "r", "r_next", "x.*"), "strategy")
    gap = rows.select("ticker", "date", (net(F.col("w10"), F.col("r")) - net(F.col("final_size"), F.col("r"))).alias("d"))

    def equivalence(x: pd.DataFrame) -> dict:
        v = x["d"].dropna().to_numpy(dtype=float)
        sd = float(v.std(ddof=1)) if len(v) > 1 else 0.0
        return {"tost_p": inference.tost_p(float(v.mean()), sd, len(v), 0.5 / 252**0.5 * sd)}

    dm = inference.diebold_mariano(gap.withColumnRenamed("ticker", "key")).select(F.col("key").alias("ticker"), "dm", F.col("p").alias("dm_p"))
    return result.join(inference.by_key(gap, "ticker", equivalence, "tost_p double"), "ticker").join(dm, "ticker")


@query()
def q11_drift_dependence(spark, d):
    """Whether the learner's gain over the rule goes with the drift of the test days, for two and three states."""
    rows = learned(spark, d, 2).unionByName(learned(spark, d, 3))
    of = lambda c, n: performance(rows.withColumn("w", F.col(c)), "k").select("ticker", "k", F.col("sharpe").alias(n))
    drift = features(spark, d).where(F.col("date") > CALIBRATION_END).groupBy("ticker").agg((F.avg("r") * 252).alias("drift"))
    out = of("w10", "learner").join(of("final_size", "rule"), ["ticker", "k"]).join(drift, "ticker").withColumn("gain", F.col("learner") - F.col("rule"))
    rho = inference.spearman(out, "drift", "gain", "k").select("k", "rho", "p")
    return out.join(rho, "k").withColumn("rule_wins", F.count_if(F.col("gain") < 0).over(W.partitionBy("k")))


@query()
def q12_recalibration(spark, d):
    """Both models of each ticker fitted, published, fitted again by the same pipeline, compared with what was published, and published as
    the next version, the one before staying as the backup."""
    rows = calibration(inputs(spark, d))
    returns = calibration(features(spark, d)).where("r is not null")
    root = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    fits = {"regimes": lambda: models.fit_regimes(rows, (3,)), "volatility": lambda: models.fit_volatility(returns)}
    same, versions = {}, {}
    for name, fit in fits.items():
        models.publish(fit(), f"{root}/{name}")
        versions[name] = models.publish(fit(), f"{root}/{name}")
    old, new = ({n: models.published(spark, f"{root}/{n}", versions[n] - k) for n in fits} for k in (1, 0))
    same["volatility"] = models.same_parameters(old["volatility"], new["volatility"]).withColumnRenamed("same", "same_volatility")
    left, right = (t["regimes"].select("ticker", "seed", *[F.col(c).alias(f"{c}_{x}") for c in ("loglik", "trans")]) for t, x in ((old, "old"), (new, "new")))
    close = F.forall(F.arrays_zip("trans_old", "trans_new"), lambda x: F.abs(x["trans_old"] - x["trans_new"]) < 1e-6) & (F.abs(F.col("loglik_old") - F.col("loglik_new")) < 1e-6)
    same["regimes"] = left.join(right, ["ticker", "seed"]).select("ticker", close.alias("same_regimes"))
    stay = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.element_at("trans", i * 4 + 1))
    table = new["regimes"].select("ticker", "n", "seed", "loglik", stay.alias("stay")).join(new["volatility"].select("ticker", "omega", "alpha", "beta", "nu", (F.col("alpha") + F.col("beta")).alias("persistence")), "ticker")
    out = table.join(same["volatility"], "ticker").join(same["regimes"], "ticker", "left")
    return out.withColumns({"same_regimes": F.coalesce("same_regimes", F.lit(False)), "version": F.lit(versions["regimes"]), "backup": F.lit(versions["regimes"] - 1)})


@query()
def q14_regime_timeline(spark, d):
    """State of each day, price carried forward, and occupancy by span."""
    rows = features(spark, d)
    states = recursions.regimes(inputs(spark, d).select("ticker", "date", "r", "rv")).select("ticker", "date", "state")
    span = F.when(F.col("date") <= CALIBRATION_END, "calibration").otherwise("test")
    out = states.join(rows.select("ticker", "date", "close"), ["ticker", "date"], "left").withColumns({"close": filled_forward(F.col("close")), "span": span})
    share = F.count("*").over(W.partitionBy("ticker", "span", "state")) / F.count("*").over(W.partitionBy("ticker", "span"))
    return out.withColumn("occupancy", share)


@query("SELECT ticker, count(*) AS days, min(date) AS first_day, max(date) AS last_day, count(*) || ' days (' || min(date) || ' to ' || max(date) || ')' AS label FROM bt WHERE net IS NOT NULL GROUP BY ticker")
def q15_windows(spark, d):
    """The window that a comparison covers."""
    out = ran(spark, d).where("net is not null").groupBy("ticker").agg(F.count("*").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return out.withColumn("label", F.concat(F.col("days"), F.lit(" days ("), F.date_format("first_day", "yyyy-MM-dd"), F.lit(" to "), F.date_format("last_day", "yyyy-MM-dd"), F.lit(")")))


def digits(x: Column) -> Column:
    """Six significant digits: numbers that grow without bound cannot be compared by their places."""
    return F.when(x.isNotNull(), F.format_string("%.5e", x).cast("double") + 0.0)


DIGITS = lambda x: f"CAST(printf('%.5e', ({x})::DOUBLE) AS DOUBLE) + 0.0"


NINE = {
    "hold": ("1.0::DOUBLE", lambda: F.lit(1.0)), "short": ("-1.0::DOUBLE", lambda: F.lit(-1.0)), "coin": ("CASE WHEN cast(datediff('day', DATE '1970-01-01', date) AS BIGINT) * 2654435761 % 1024 < 512 THEN 1.0::DOUBLE ELSE -1 END", lambda: F.when(F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long") * 2654435761 % 1024 < 512, 1.0).otherwise(-1.0)),
    "agent": ("size", lambda: F.col("size")), "reduce": (MODES["ram_continuous"][0], lambda: supervision.decided("reduce", reduce="ram_continuous")[0]), "bucket": (MODES["bucket"][0], lambda: supervision.decided("reduce")[0]),
    "neutral": (MODES["A"][0], lambda: supervision.decided("override", "A")[0]), "override": (MODES["C"][0], lambda: supervision.decided("override", "C")[0]), "regime": ("rs * bound", lambda: F.col("regime_sign") * F.col("bound")),
}
_LONG = " UNION ALL ".join(f"SELECT '{k}' AS strategy, ticker, date, r, r_next, ({v[0]})::DOUBLE AS w FROM det" for k, v in NINE.items())
_NINE_SQL = f"""{DET_SQL}, lo AS ({_LONG}), ln AS (SELECT *, coalesce(lag(w) OVER o, 0) * r - 0.0001::DOUBLE * abs(coalesce(lag(w) OVER o, 0) - coalesce(lag(w, 2) OVER o, 0)) AS net, abs(w - lag(w) OVER o) AS turned FROM lo WINDOW o AS (PARTITION BY strategy, ticker ORDER BY date)),
 lc AS (SELECT *, product(1 + coalesce(net, 0)) OVER (PARTITION BY strategy, ticker ORDER BY date) AS curve FROM ln), ld AS (SELECT *, curve / max(curve) OVER (PARTITION BY strategy, ticker ORDER BY date) - 1 AS dd FROM lc)"""


def nine(spark, d) -> DataFrame:
    """strategy, ticker, date, r, r_next, w, net of nine strategies over the decision days."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v[1]().cast("double").alias("w")) for k, v in NINE.items()])).alias("x")
    long = detected(spark, d).select("ticker", "date", "r", "r_next", parts).select("x.strategy", "ticker", "date", "r", "r_next", "x.w")
    return long.withColumn("net", net(F.col("w"), F.col("r"), "strategy"))


@query(f", {_NINE_SQL} SELECT strategy, ticker, count(net) AS n, {R('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)')} AS sharpe, {R('avg(net) / nullif(sqrt(avg(least(net, 0) ** 2)), 0) * sqrt(252)')} AS sortino, {DIGITS('min(dd)')} AS max_drawdown, {DIGITS('(CASE WHEN max_by(curve, date) > 0 THEN max_by(curve, date) END ** (252.0 / count(net)) - 1) / nullif(abs(min(dd)), 0)')} AS calmar, {R('sum(net)')} AS total, {R('stddev_samp(net) * sqrt(252)')} AS volatility, {R('avg(CASE WHEN net > 0 THEN 1.0::DOUBLE WHEN net IS NOT NULL THEN 0 END)')} AS hit_rate, {R('avg(CASE WHEN r_next <> 0 THEN CASE WHEN sign(w) = sign(r_next) THEN 1.0::DOUBLE ELSE 0 END END)')} AS accuracy, {R('avg(turned)')} AS turnover FROM ld GROUP BY strategy, ticker")
def i9_x6_nine_strategies(spark, d):
    """The table of nine strategies and ten figures."""
    return figures(nine(spark, d))


def figures(rows: DataFrame) -> DataFrame:
    """Ten figures of each strategy and ticker of rows (strategy, ticker, date, r_next, w, net)."""
    order = W.partitionBy("strategy", "ticker").orderBy("date")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    df = rows.withColumns({"curve": F.product(1 + F.coalesce("net", F.lit(0.0))).over(run), "turned": F.abs(F.col("w") - F.lag("w").over(order))})
    df = df.withColumn("dd", F.col("curve") / F.max("curve").over(run) - 1)
    x = F.col("net")
    out = df.groupBy("strategy", "ticker").agg(F.count(x).alias("n"), backtest.sharpe(x).alias("sharpe"), backtest.sortino(x).alias("sortino"), F.min("dd").alias("max_drawdown"), F.max_by("curve", "date").alias("final"), F.sum(x).alias("total"), (F.stddev_samp(x) * 252**0.5).alias("volatility"), F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias("hit_rate"), F.avg(F.when(F.col("r_next") != 0, (F.signum("w") == F.signum("r_next")).cast("double"))).alias("accuracy"), F.avg("turned").alias("turnover"))
    calmar = (F.pow(F.when(F.col("final") > 0, F.col("final")), 252.0 / F.col("n")) - 1) / F.nullif(F.abs("max_drawdown"), F.lit(0.0))
    return out.select("strategy", "ticker", "n", *r6(**{c: F.col(c) for c in ("sharpe", "sortino")}), digits(F.col("max_drawdown")).alias("max_drawdown"), digits(calmar).alias("calmar"), *r6(**{c: F.col(c) for c in ("total", "volatility", "hit_rate", "accuracy", "turnover")}))


@query()
def x7_comparison(spark, d):
    """Every pair of strategies by Diebold-Mariano, with p, and the deflated Sharpe ratio of both."""
    df = nine(spark, d).where("net is not null")
    one = df.select("strategy", "ticker", "date", "net")
    a, b = one.alias("a"), one.alias("b")
    pairs = a.join(b, (F.col("a.ticker") == F.col("b.ticker")) & (F.col("a.date") == F.col("b.date")) & (F.col("a.strategy") < F.col("b.strategy")))
    gap = pairs.select(F.concat_ws("|", "a.ticker", "a.strategy", "b.strategy").alias("key"), F.col("a.date").alias("date"), (F.col("b.net") - F.col("a.net")).alias("d"))
    out = inference.diebold_mariano(gap).withColumn("x", F.split("key", "[|]")).select(F.col("x")[0].alias("ticker"), F.col("x")[1].alias("first"), F.col("x")[2].alias("second"), "n", "dm", "p")
    m, s = F.avg("net"), F.stddev_samp("net")
    stats = df.groupBy("ticker", "strategy").agg(F.count("*").alias("n"), m.alias("m"), s.alias("s"), *[F.avg(F.col("net") ** k).alias(f"a{k}") for k in (2, 3, 4)])

    @F.pandas_udf("double")
    def deflated(n: pd.Series, m: pd.Series, s: pd.Series, a2: pd.Series, a3: pd.Series, a4: pd.Series) -> pd.Series:
        def one(n, m, s, a2, a3, a4):
            if not s > 0:
                return None
            skew, kurt = (a3 - 3 * m * a2 + 2 * m**3) / s**3, (a4 - 4 * m * a3 + 6 * m**2 * a2 - 3 * m**4) / s**4
            return inference.deflated_sharpe(m / s, len(NINE), int(n), skew, kurt)

        return pd.Series([one(*v) for v in zip(n, m, s, a2, a3, a4, strict=True)], dtype=object)

    dsr = stats.select("ticker", "strategy", deflated("n", "m", "s", "a2", "a3", "a4").alias("dsr"))
    return out.join(dsr.select("ticker", F.col("strategy").alias("first"), F.col("dsr").alias("first_dsr")), ["ticker", "first"]).join(dsr.select("ticker", F.col("strategy").alias("second"), F.col("dsr").alias("second_dsr")), ["ticker", "second"])


@query(f", {_NINE_SQL} SELECT strategy, ticker, date, {R('w')} AS w, {DIGITS('curve')} AS equity, {DIGITS('dd')} AS drawdown FROM ld")
def q16_figure_tables(spark, d):
    """Sizing, equity and drawdown of each strategy by day."""
    run = W.partitionBy("strategy", "ticker").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    df = nine(spark, d).withColumn("curve", F.product(1 + F.coalesce("net", F.lit(0.0))).over(run))
    return df.select("strategy", "ticker", "date", *r6(w=F.col("w")), digits(F.col("curve")).alias("equity"), digits(F.col("curve") / F.max("curve").over(run) - 1).alias("drawdown"))


@query()
def m31_threshold_halves(spark, d):
    """Sharpe of the learner's position by its threshold in the first and second half of the days, and the rank correlation of the two orders."""
    got = learning.out_of_fold(predictions(spark, d), "ticker").join(meta_rows(spark, d).select("ticker", "row_pos", "r_next"), ["ticker", "row_pos"])
    cut = F.explode(F.array(*map(F.lit, (0.40, 0.45, 0.50, 0.55, 0.60)))).alias("cut")
    half = F.when(F.row_number().over(W.partitionBy("ticker").orderBy("row_pos")) <= F.floor(F.count("*").over(W.partitionBy("ticker")) / 2), 1).otherwise(2)
    pnl = got.withColumn("half", half).select("*", cut).withColumn("x", F.signum(F.col("p") - F.col("cut")) * F.col("r_next"))
    sharpe = lambda h: backtest.sharpe(F.when(F.col("half") == h, F.col("x")))
    table = pnl.groupBy("ticker", "cut").agg(sharpe(1).alias("first"), sharpe(2).alias("second"))
    return table.join(inference.spearman(table, "first", "second", "ticker").select("ticker", "rho", "p"), "ticker", "left")
