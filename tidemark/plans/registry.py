"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.series import by, prefix, average_rank, filled_forward, log_return, momentum, rolling, rounded
from tidemark.operators import backtest, folds, inference, recursions, supervision
from tidemark.sources import bridge, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {bridge.SQL}{sql}" if sql.lstrip().startswith(",") else f"WITH {bridge.SQL} {sql}")
        return f

    return add


def r6(**columns) -> list:
    return [rounded(c).alias(n) for n, c in columns.items()]


def rets(spark, d) -> DataFrame:
    return bridge.bars(spark, d).withColumn("r", log_return(F.col("close")))


def labelled(spark, d) -> DataFrame:
    """Decisions with the market calendar's next return and the regime probabilities."""
    label = rets(spark, d).select("ticker", "date", "r", F.lead("r").over(by()).alias("r_next"))
    return bridge.decisions(spark, d).join(label, ["ticker", "date"], "left").join(bridge.regimes(spark, d), ["ticker", "date"], "left")


def ran(spark, d) -> DataFrame:
    return backtest.run(rets(spark, d), bridge.decisions(spark, d))


WIN = "OVER (PARTITION BY ticker ORDER BY date)"
ROLL = lambda f, x, n: f"CASE WHEN count({x}) OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) >= {n} THEN {f}({x}) OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) END"
R = lambda x: f"round({x} + 1e-9, 6) + 0.0"
LAGS = ", ".join(f"{R(f'lag(r, {k}) {WIN}')} AS ret_lag_{k}" for k in range(1, 6))


@query(f"""SELECT ticker, date, {R('r')} AS ret_log, {R(ROLL('stddev_samp', 'r', 5))} AS rv_5, {R(f"({ROLL('stddev_samp', 'r', 21)}) * sqrt(252)")} AS rv_21_ann,
 {R(ROLL('avg', 'close', 50))} AS sma_50, {R(ROLL('avg', 'close', 200))} AS sma_200, {R(f'close / lag(close, 22) {WIN} - 1')} AS mom_22, {LAGS} FROM rets""")
def f_features(spark, d):
    r, p = F.col("r"), F.col("close")
    lags = {f"ret_lag_{k}": F.lag("r", k).over(by()) for k in range(1, 6)}
    return rets(spark, d).select("ticker", "date", *r6(ret_log=r, rv_5=rolling(F.stddev_samp, r, 5), rv_21_ann=rolling(F.stddev_samp, r, 21) * 252**0.5, sma_50=rolling(F.avg, p, 50), sma_200=rolling(F.avg, p, 200), mom_22=momentum(p, 22), **lags))


@query(f""", steps AS (SELECT ticker, date, row_number() {WIN} - 1 AS i, close - lag(close) {WIN} AS s FROM daily),
 ew AS (SELECT ticker, date, i, greatest(s, 0) AS up, greatest(-s, 0) AS down FROM steps WHERE i = 1
  UNION ALL SELECT s.ticker, s.date, s.i, e.up * 13 / 14 + greatest(s.s, 0) / 14, e.down * 13 / 14 + greatest(-s.s, 0) / 14 FROM ew e JOIN steps s ON s.ticker = e.ticker AND s.i = e.i + 1)
 SELECT d.ticker, d.date, {R('CASE WHEN i >= 14 AND down > 0 THEN 100 - 100 / (1 + up / down) END')} AS rsi_14 FROM daily d LEFT JOIN ew e USING (ticker, date)""")
def f4_rsi(spark, d):
    return recursions.rsi(bridge.bars(spark, d)).select("ticker", "date", *r6(rsi_14=F.col("rsi_14")))


@query("SELECT ticker, date, action, round(size, 6) AS size, CASE WHEN action = 'long' THEN round(confidence, 6) WHEN action = 'short' THEN round(1 - confidence, 6) ELSE 0.5 END AS p_up, CASE WHEN date <= DATE '1999-12-31' THEN 'calibration' ELSE 'oos' END AS span, greatest(-1, least(1, CASE WHEN action = 'hold' THEN 0 ELSE round(size * 3, 6) END)) + 0.0 AS clipped FROM dec")
def f11_mapping(spark, d):
    up = F.when(F.col("action") == "long", F.round("confidence", 6)).when(F.col("action") == "short", F.round(1 - F.col("confidence"), 6)).otherwise(0.5)
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(F.col("action") == "hold", 0.0).otherwise(F.round(F.col("size") * 3, 6)))) + 0.0
    return bridge.decisions(spark, d).select("ticker", "date", "action", F.round("size", 6).alias("size"), up.alias("p_up"), F.when(F.col("date") <= "1999-12-31", "calibration").otherwise("oos").alias("span"), clipped.alias("clipped"))


@query("SELECT CASE WHEN s > -0.01 AND s <= 0.2 THEN 'z1' WHEN s <= 0.4 THEN 'z2' WHEN s <= 0.7 THEN 'z3' ELSE 'z4' END AS zone, count(*) AS n FROM (SELECT CASE WHEN abs(size) < 1e-9 THEN 0 WHEN size < 0 THEN calm ELSE crisis END AS s FROM dl) GROUP BY 1")
def f17_zones(spark, d):
    s = supervision.ram_score(F.col("size"), F.col("calm"), F.col("crisis"))
    return labelled(spark, d).select(s.alias("s")).groupBy(F.when((F.col("s") > -0.01) & (F.col("s") <= 0.2), "z1").when(F.col("s") <= 0.4, "z2").when(F.col("s") <= 0.7, "z3").otherwise("z4").alias("zone")).agg(F.count("*").alias("n"))


@query(f"SELECT ticker, date, {R('r')} AS r, {R('w')} AS w, {R('gross')} AS gross, {R('cost')} AS cost, {R('net')} AS net, {R(f'CASE WHEN net IS NOT NULL THEN product(1 + net) {WIN} END')} AS equity FROM bt")
def st1_backtest(spark, d):
    return ran(spark, d).select("ticker", "date", *r6(**{c: F.col(c) for c in ("r", "w", "gross", "cost", "net", "equity")}))


METRICS_SQL = f"""SELECT ticker, count(net) AS n, {R('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)')} AS sharpe, {R('avg(net) / nullif(sqrt(avg(least(net, 0) ** 2)), 0) * sqrt(252)')} AS sortino,
 {R('min(dd)')} AS max_drawdown, {R('max_by(curve, date)')} AS final, {R("CASE WHEN sum(least(net, 0)) < 0 THEN sum(greatest(net, 0)) / -sum(least(net, 0)) WHEN sum(greatest(net, 0)) > 0 THEN 'inf'::DOUBLE END")} AS profit_factor, {R('avg(CASE WHEN net > 0 THEN 1.0::DOUBLE WHEN net IS NOT NULL THEN 0 END)')} AS hit_rate, {R('avg(turned)')} AS turnover,
 {R('(CASE WHEN max_by(curve, date) > 0 THEN max_by(curve, date) END ** (252.0 / count(net)) - 1) / nullif(abs(min(dd)), 0)')} AS calmar
 FROM (SELECT *, curve / max(curve) {WIN} - 1 AS dd FROM (SELECT *, product(1 + coalesce(net, 0)) {WIN} AS curve, abs(w - lag(w) {WIN}) AS turned FROM bt)) GROUP BY ticker"""


@query(METRICS_SQL)
def m_summary(spark, d):
    out = backtest.metrics(ran(spark, d))
    return out.select("ticker", "n", *r6(**{c: F.col(c) for c in ("sharpe", "sortino", "max_drawdown", "final", "profit_factor", "hit_rate", "turnover", "calmar")}))


def matthews(up, y):
    """Correlation of two binary columns; 0 if a margin is empty."""
    tp, tn, fp, fn = (F.count_if(c).cast("double") for c in (up & y, ~up & ~y, up & ~y, ~up & y))
    return F.coalesce((tp * tn - fp * fn) / F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0)), F.lit(0.0))


def flagship(spark, sf_dir):
    return m_summary(spark, sf_dir)


@query(f"SELECT ticker, date, {R('curve / max(curve) ' + WIN + ' - 1')} AS drawdown FROM (SELECT *, product(1 + coalesce(net, 0)) {WIN} AS curve FROM bt)")
def m22_drawdowns(spark, d):
    return backtest.with_drawdown(ran(spark, d)).select("ticker", "date", *r6(drawdown=F.col("drawdown")))


RANKS = "SELECT ticker, y, p, rank() OVER (PARTITION BY ticker ORDER BY p) + (count(*) OVER (PARTITION BY ticker, p) - 1) / 2.0::DOUBLE AS k FROM (SELECT ticker, round(p, 9) AS p, CASE WHEN r_next > 0 THEN 1 ELSE 0 END AS y FROM (SELECT *, CASE WHEN action = 'long' THEN confidence WHEN action = 'short' THEN 1 - confidence ELSE 0.5 END AS p FROM dl) WHERE r_next IS NOT NULL AND r_next <> 0)"


MCC = "coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"
CELLS = {"tp": "CAST(count_if(p >= 0.5 AND y = 1) AS DOUBLE)", "tn": "count_if(p < 0.5 AND y = 0)", "fp": "count_if(p >= 0.5 AND y = 0)", "fn": "count_if(p < 0.5 AND y = 1)"}


def with_cells(text: str, cells: dict[str, str]) -> str:
    for k, v in cells.items():
        text = text.replace(k, v)
    return text


@query(f"""SELECT ticker, count(*) AS n, {R('avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy, {R(with_cells(MCC, CELLS))} AS mcc,
 {R('(sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0)')} AS auc,
 {R('CASE WHEN min(y) < max(y) THEN avg(-ln(greatest(1e-15::DOUBLE, CASE WHEN y = 1 THEN least(p, 1 - 1e-15::DOUBLE) ELSE 1 - least(p, 1 - 1e-15::DOUBLE) END))) END')} AS log_loss, {R('avg((p - y) ** 2)')} AS brier FROM ({RANKS}) GROUP BY ticker""")
def m10_classification(spark, d):
    """A probability of one half counts as up; with one class only there is no AUC and no log loss, and an empty margin makes MCC 0."""
    p = F.when(F.col("action") == "long", F.col("confidence")).when(F.col("action") == "short", 1 - F.col("confidence")).otherwise(0.5)
    df = labelled(spark, d).where("r_next is not null and r_next <> 0").select("ticker", F.round(p, 9).alias("p"), (F.col("r_next") > 0).cast("int").alias("y"))
    df = df.withColumn("k", average_rank(F.col("p"), "ticker"))
    up, y, q = F.col("p") >= 0.5, F.col("y") == 1, F.least(F.col("p"), F.lit(1 - 1e-15))
    ones, zeros = F.sum("y"), F.sum(1 - F.col("y"))
    loss = F.avg(-F.log(F.greatest(F.lit(1e-15), F.when(y, q).otherwise(1 - q))))
    return df.groupBy("ticker").agg(F.count("*").alias("n"), *r6(
        accuracy=F.avg((up == y).cast("double")), mcc=matthews(up, y), auc=(F.sum(F.when(y, F.col("k"))) - ones * (ones + 1) / 2) / F.nullif(ones * zeros, F.lit(0)),
        log_loss=F.when((ones > 0) & (zeros > 0), loss), brier=F.avg((F.col("p") - F.col("y")) ** 2),
    ))


@query(f"SELECT ticker, count(*) AS n, {R('avg(CASE WHEN sign(size) = sign(r_next) THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy, {R('avg(CASE WHEN size <> 0 THEN CASE WHEN sign(size) = sign(r_next) THEN 1.0::DOUBLE ELSE 0 END END)')} AS hit_rate, count_if(size <> 0) AS n_active FROM dl WHERE r_next IS NOT NULL AND r_next <> 0 GROUP BY ticker")
def m11_directional(spark, d):
    right = (F.signum("size") == F.signum("r_next")).cast("double")
    return labelled(spark, d).where("r_next is not null and r_next <> 0").groupBy("ticker").agg(F.count("*").alias("n"), *r6(accuracy=F.avg(right), hit_rate=F.avg(F.when(F.col("size") != 0, right))), F.count_if(F.col("size") != 0).alias("n_active"))


@query("SELECT coalesce(CAST(up AS VARCHAR), 'all') AS actual, coalesce(CAST(p AS VARCHAR), 'all') AS predicted, count(*) AS n FROM (SELECT CASE WHEN r_next > 0 THEN 1 ELSE 0 END AS up, CASE WHEN size > 0 THEN 1 ELSE 0 END AS p FROM dl WHERE r_next IS NOT NULL AND r_next <> 0) GROUP BY CUBE (up, p)")
def m12_confusion(spark, d):
    df = labelled(spark, d).where("r_next is not null and r_next <> 0").select((F.col("r_next") > 0).cast("int").cast("string").alias("a"), (F.col("size") > 0).cast("int").cast("string").alias("p"))
    return df.cube("a", "p").agg(F.count("*").alias("n")).select(F.coalesce("a", F.lit("all")).alias("actual"), F.coalesce("p", F.lit("all")).alias("predicted"), "n")


@query(f"SELECT ticker, {R('avg(CASE WHEN sign(a) = sign(b) THEN 1.0::DOUBLE ELSE 0 END)')} AS concord, {R('sum(CASE WHEN sign(a) <> sign(b) THEN (b - a) * r_next ELSE 0 END)')} AS by_flip, {R('sum(CASE WHEN sign(a) = sign(b) THEN (b - a) * r_next ELSE 0 END)')} AS by_size FROM (SELECT *, size AS a, CASE WHEN calm >= crisis THEN 1 ELSE -1 END * 0.1::DOUBLE AS b FROM dl WHERE r_next IS NOT NULL) GROUP BY ticker")
def m13_m14_concordance(spark, d):
    df = labelled(spark, d).where("r_next is not null").select("ticker", F.col("size").alias("a"), (F.when(F.col("calm") >= F.col("crisis"), 1).otherwise(-1) * F.lit(0.1)).alias("b"), "r_next")
    same, moved = F.signum("a") == F.signum("b"), (F.col("b") - F.col("a")) * F.col("r_next")
    return df.groupBy("ticker").agg(*r6(concord=F.avg(same.cast("double")), by_flip=F.sum(F.when(~same, moved).otherwise(0.0)), by_size=F.sum(F.when(same, moved).otherwise(0.0))))


REGIME = "CASE WHEN calm >= stress AND calm >= crisis THEN 'calm' WHEN stress >= crisis THEN 'stress' ELSE 'crisis' END"


def dominant():
    return F.when((F.col("calm") >= F.col("stress")) & (F.col("calm") >= F.col("crisis")), "calm").when(F.col("stress") >= F.col("crisis"), "stress").otherwise("crisis")


@query(f"SELECT state, {R('avg(r)')} AS mean, {R('stddev_pop(r)')} AS sd, {R('avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS share_up, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()')} AS occupancy FROM (SELECT r, {REGIME} AS state FROM rets JOIN reg USING (ticker, date) WHERE r IS NOT NULL) GROUP BY state")
def m16_m17_regime_table(spark, d):
    df = rets(spark, d).join(bridge.regimes(spark, d), ["ticker", "date"]).where("r is not null").withColumn("state", dominant())
    out = df.groupBy("state").agg(*r6(mean=F.avg("r"), sd=F.stddev_pop("r"), share_up=F.avg((F.col("r") > 0).cast("double"))), F.count("*").alias("n"))
    return out.withColumn("occupancy", rounded(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))))  # one row a state


@query(f"SELECT fire, count(*) AS n, {R('avg(CASE WHEN sign(size) = sign(r_next) THEN 1.0::DOUBLE ELSE 0 END)')} AS follow_agent, {R('avg(CASE WHEN CASE WHEN calm >= crisis THEN 1 ELSE -1 END = sign(r_next) THEN 1.0::DOUBLE ELSE 0 END)')} AS follow_regime FROM (SELECT *, CASE WHEN abs(size) < 1e-9 THEN 0 WHEN size < 0 THEN calm ELSE crisis END >= 0.4 AS fire FROM dl WHERE r_next IS NOT NULL AND r_next <> 0) GROUP BY fire")
def m15_conditional(spark, d):
    df = labelled(spark, d).where("r_next is not null and r_next <> 0").withColumn("fire", supervision.ram_score(F.col("size"), F.col("calm"), F.col("crisis")) >= 0.4)
    sign = F.signum("r_next")
    return df.groupBy("fire").agg(F.count("*").alias("n"), *r6(follow_agent=F.avg((F.signum("size") == sign).cast("double")), follow_regime=F.avg((F.when(F.col("calm") >= F.col("crisis"), 1.0).otherwise(-1.0) == sign).cast("double"))))


PCT = (50, 75, 90, 95, 99)


@query("SELECT ticker, " + ", ".join(f"{R(f'quantile_cont(abs(r), {p / 100})')} AS p{p}" for p in PCT) + f", {R('max(abs(r))')} AS top FROM rets WHERE r IS NOT NULL GROUP BY ticker")
def m19_percentiles(spark, d):
    return rets(spark, d).where("r is not null").groupBy("ticker").agg(*r6(**{f"p{p}": F.percentile(F.abs("r"), F.lit(p / 100)) for p in PCT}, top=F.max(F.abs("r"))))


@query(f"SELECT ticker, {R('any_value(m)')} AS mean, {R('any_value(s)')} AS sd, {R('avg(((r - m) / s) ** 3)')} AS skew, {R('avg(((r - m) / s) ** 4)')} AS kurt, {R('any_value(m) * 252')} AS drift, {R('any_value(s) * sqrt(252)')} AS vol FROM (SELECT ticker, r, avg(r) OVER (PARTITION BY ticker) AS m, stddev_samp(r) OVER (PARTITION BY ticker) AS s FROM rets WHERE r IS NOT NULL) GROUP BY ticker")
def m20_m24_moments(spark, d):
    """From power sums, so that each ticker's rows are aggregated before they are shuffled."""
    df = rets(spark, d).where("r is not null")
    out = df.groupBy("ticker").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), *[F.avg(F.col("r") ** k).alias(f"a{k}") for k in (2, 3, 4)])
    m, s = F.col("m"), F.col("s")
    third = F.col("a3") - 3 * m * F.col("a2") + 2 * m**3
    fourth = F.col("a4") - 4 * m * F.col("a3") + 6 * m**2 * F.col("a2") - 3 * m**4
    return out.select("ticker", *r6(mean=m, sd=s, skew=third / s**3, kurt=fourth / s**4, drift=m * 252, vol=s * 252**0.5))


@query(f""", g AS (SELECT ticker, date, row_number() {WIN} AS i, r FROM rets WHERE r IS NOT NULL),
 path AS (SELECT ticker, date, i, r, 0.0144::DOUBLE + 0.8735::DOUBLE AS v FROM g WHERE i = 1
  UNION ALL SELECT g.ticker, g.date, g.i, g.r, 0.0144::DOUBLE + 0.1222::DOUBLE * (100 * p.r - 0.0788::DOUBLE) ** 2 + 0.8735::DOUBLE * p.v FROM path p JOIN g ON g.ticker = p.ticker AND g.i = p.i + 1)
 SELECT ticker, date, {R('sqrt(v * 252) / 100')} AS sigma FROM path""")
def st2_garch(spark, d):
    return recursions.garch(rets(spark, d).where("r is not null").select("ticker", "date", "r")).select("ticker", "date", *r6(sigma=F.col("sigma")))


DET_SQL = """det0 AS (SELECT *, (stress + crisis) / 2 AS sigma, least(1, 0.10::DOUBLE / ((stress + crisis) / 2)) AS bound, CASE WHEN abs(size) < 1e-9 THEN 0 WHEN size < 0 THEN calm ELSE crisis END AS ram, confidence * calm AS psa FROM dl),
det1 AS (SELECT *, greatest(0, abs(size) - bound) / greatest(bound, 0.001::DOUBLE) AS gso, CASE WHEN size <> 0 THEN abs(log2(abs(size) / greatest(bound, 0.001::DOUBLE))) ELSE 3 END AS gso_rel FROM det0),
det AS (SELECT *, CASE WHEN ram >= 0.7 THEN 3 WHEN ram >= 0.4 THEN 2 WHEN ram >= 0.2 THEN 1 ELSE 0 END AS ro, CASE WHEN gso >= 0.7 THEN 3 WHEN gso >= 0.4 THEN 2 WHEN gso >= 0.2 THEN 1 ELSE 0 END AS go,
 CASE WHEN psa >= 0.7 THEN 3 WHEN psa >= 0.4 THEN 2 WHEN psa >= 0.2 THEN 1 ELSE 0 END AS po, sign(size) * least(abs(size), bound) AS bounded, CASE WHEN calm >= crisis THEN 1 ELSE -1 END AS rs, greatest(calm, crisis) AS pd FROM det1)"""
NAMED = lambda c: f"['none', 'low', 'medium', 'high'][{c} + 1]"


def detected(spark, d):
    df = labelled(spark, d).withColumn("sigma", (F.col("stress") + F.col("crisis")) / 2).withColumn("psa", F.col("confidence") * F.col("calm"))
    return supervision.detect(df).withColumn("psa_severity", supervision.severity(F.col("psa"), supervision.CUTS["psa"]))


@query(f", {DET_SQL} SELECT ticker, date, {R('ram')} AS ram, {NAMED('ro')} AS ram_severity, ro >= 2 AS ram_flag, {R('bound')} AS bound, {R('gso')} AS gso, {NAMED('go')} AS gso_severity, gso > 0 AS gso_flag, {R('bounded')} AS bounded, {R('gso_rel')} AS gso_rel, CASE WHEN gso_rel < 0.3 THEN 'none' WHEN gso_rel < 0.585 THEN 'low' WHEN gso_rel < 1 THEN 'medium' ELSE 'high' END AS rel_severity, {R('sign(size) * bound')} AS rescaled, {R('sign(size) * least(1, abs(size) / 0.25) * bound')} AS convicted FROM det")
def d_detectors(spark, d):
    num = ("ram", "bound", "gso", "bounded", "gso_rel", "rescaled", "convicted")
    return detected(spark, d).select("ticker", "date", *r6(**{c: F.col(c) for c in num}), "ram_severity", "ram_flag", "gso_severity", "gso_flag", "rel_severity")


ONE = "CASE WHEN go >= 2 THEN bounded ELSE size END"
OVER = lambda v: f"CASE WHEN po = 3 THEN 0.5 ELSE 1 END * CASE WHEN ro >= 2 THEN {v} ELSE {ONE} END"
MODES = {
    "warn": ("size", "false"), "bucket": ("size * (1 - [0, 0.25, 0.6, 1][greatest(ro, po, go) + 1])", "greatest(ro, po, go) > 0"),
    "continuous": ("size * (1 - least(1, greatest(ram, psa, gso)))", "least(1, greatest(ram, psa, gso)) > 0"),
    "ram_continuous": ("size * (1 - CASE WHEN ro >= 2 THEN ram ELSE 0 END)", "ro >= 2"),
    "A": (OVER("0"), None), "B": (OVER("0.5 * rs * bound * pd"), None), "C": (OVER("rs * bound"), None), "D": (OVER("rs * abs(size)"), None),
}
ACTION = lambda f: f"CASE WHEN abs({f}) < 1e-9 THEN 'hold' WHEN {f} > 0 THEN 'long' ELSE 'short' END"


@query(f", {DET_SQL} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, ticker, date, {R(f)} AS final_size, {'action' if m == 'warn' else ACTION('(' + f + ')')} AS final_action, {t or 'go >= 2 OR ro >= 2 OR po = 3'} AS was_intervened FROM det" for m, (f, t) in MODES.items()))
def i_interventions(spark, d):
    """Every mode side by side on one pass over the decisions."""
    df, parts = detected(spark, d), []
    for m in MODES:
        args = {"mode": "warn"} if m == "warn" else {"mode": "override", "variant": m} if len(m) == 1 else {"mode": "reduce", "reduce": m}
        size, action, touched = supervision.decided(**args)
        parts.append(F.struct(F.lit(m).alias("mode"), rounded(size).alias("final_size"), action.alias("final_action"), touched.alias("was_intervened")))
    return df.select("ticker", "date", F.explode(F.array(*parts)).alias("x")).select("x.mode", "ticker", "date", "x.final_size", "x.final_action", "x.was_intervened")


@query(f", {DET_SQL} SELECT detector, level, count(*) AS n FROM (SELECT 'ram' AS detector, {NAMED('ro')} AS level FROM det UNION ALL SELECT 'psa', {NAMED('po')} FROM det UNION ALL SELECT 'gso', {NAMED('go')} FROM det) GROUP BY 1, 2")
def m21_severities(spark, d):
    long = detected(spark, d).select(F.explode(F.array(*[F.struct(F.lit(x).alias("detector"), F.col(f"{x}_severity").alias("level")) for x in ("ram", "psa", "gso")])).alias("x")).select("x.*")
    return long.groupBy("detector", "level").agg(F.count("*").alias("n"))


@query(f", {DET_SQL} SELECT ticker, count(*) AS n, {R('sum(pnl)')} AS total, {R('avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS hit_rate FROM (SELECT ticker, ({MODES['C'][0]} - size) * r_next * 1e4 AS pnl FROM det WHERE abs({MODES['C'][0]} - size) > 1e-12 AND r_next IS NOT NULL) GROUP BY ticker")
def m28_intervention_pnl(spark, d):
    df = supervision.intervene(detected(spark, d), "override", "C").where(F.abs(F.col("final_size") - F.col("size")) > 1e-12).where("r_next is not null")
    pnl = (F.col("final_size") - F.col("size")) * F.col("r_next") * 1e4
    return df.groupBy("ticker").agg(F.count("*").alias("n"), *r6(total=F.sum(pnl), hit_rate=F.avg((pnl > 0).cast("double"))))


@query(f", {DET_SQL}, p AS (SELECT *, ({MODES['C'][0]} - size) * r_next * 1e4 AS pnl, CAST(ro >= 2 AS INT) + CAST(po >= 2 AS INT) + CAST(gso > 0 AS INT) AS k FROM det WHERE r_next IS NOT NULL) SELECT CASE WHEN k > 1 THEN 'multi' WHEN ro >= 2 THEN 'ram' WHEN po >= 2 THEN 'psa' ELSE 'gso' END AS bucket, count(*) AS n, {R('sum(pnl)')} AS pnl FROM p WHERE k > 0 GROUP BY 1")
def m29_attribution_exclusive(spark, d):
    df = supervision.intervene(detected(spark, d), "override", "C").where("r_next is not null").withColumn("psa_flag", F.col("psa_severity").isin("medium", "high"))
    k = sum(F.col(f"{x}_flag").cast("int") for x in ("ram", "psa", "gso"))
    bucket = F.when(k > 1, "multi").when(F.col("ram_flag"), "ram").when(F.col("psa_flag"), "psa").otherwise("gso")
    return df.where(k > 0).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), *r6(pnl=F.sum((F.col("final_size") - F.col("size")) * F.col("r_next") * 1e4)))


@query(f", {DET_SQL}, p AS (SELECT *, ({MODES['C'][0]} - size) * r_next * 1e4 AS pnl, (ro + po + go)::DOUBLE AS k FROM det WHERE r_next IS NOT NULL AND ro + po + go > 0) SELECT detector, {R('sum(s)')} AS n_act, {R('sum(s * pnl)')} AS pnl FROM (SELECT 'ram' AS detector, ro / k AS s, pnl FROM p UNION ALL SELECT 'psa', po / k, pnl FROM p UNION ALL SELECT 'gso', go / k, pnl FROM p) GROUP BY detector")
def m30_attribution_proportional(spark, d):
    df = supervision.intervene(detected(spark, d), "override", "C").where("r_next is not null")
    w = {x: supervision.order(F.col(f"{x}_severity")) for x in ("ram", "psa", "gso")}
    total = sum(w.values())
    parts = F.explode(F.array(*[F.struct(F.lit(x).alias("detector"), (c / total).alias("s")) for x, c in w.items()])).alias("x")
    long = df.where(total > 0).select(((F.col("final_size") - F.col("size")) * F.col("r_next") * 1e4).alias("pnl"), parts)
    return long.groupBy("x.detector").agg(*r6(n_act=F.sum("x.s"), pnl=F.sum(F.col("x.s") * F.col("pnl"))))


@query(f", {DET_SQL} SELECT cut, count_if(ram >= cut) AS fired, {R('avg(CASE WHEN sign(CASE WHEN ram >= cut THEN rs * bound ELSE size END) = sign(r_next) THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy FROM det, (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5)) AS g(cut) WHERE r_next IS NOT NULL AND r_next <> 0 GROUP BY cut")
def j11_i10_threshold_sweep(spark, d):
    grid = spark.createDataFrame([(x,) for x in (0.2, 0.3, 0.4, 0.5)], "cut double")
    df = detected(spark, d).where("r_next is not null and r_next <> 0").crossJoin(F.broadcast(grid))  # four constants
    w = F.when(F.col("ram") >= F.col("cut"), F.col("regime_sign") * F.col("bound")).otherwise(F.col("size"))
    return df.groupBy("cut").agg(F.count_if(F.col("ram") >= F.col("cut")).alias("fired"), *r6(accuracy=F.avg((F.signum(w) == F.signum("r_next")).cast("double"))))


def last_bars(bars: DataFrame, decisions: DataFrame) -> DataFrame:
    """Last bar at or before each decision: one ordered pass over both, no range join."""
    orders = bars.select("ticker", "date", F.struct("date", "close").alias("bar"), F.lit(False).alias("asked"))
    both = orders.unionByName(decisions.select("ticker", "date", F.lit(None).cast("struct<date: date, close: double>").alias("bar"), F.lit(True).alias("asked")))
    frame = W.partitionBy("ticker").orderBy("date", "asked").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("bar", F.last("bar", ignorenulls=True).over(frame)).where("asked and bar is not null")
    return out.select("ticker", "date", F.col("bar.date").alias("bar_date"), *r6(close=F.col("bar.close")))


@query("SELECT d.ticker, d.date, b.date AS bar_date, round(b.close + 1e-9, 6) + 0.0 AS close FROM dec d ASOF JOIN (SELECT * FROM daily WHERE ok % 3 = 0) b ON d.ticker = b.ticker AND d.date >= b.date")
def j6_asof(spark, d):
    """Over a third of the bars, as its SQL has it; j6_asof_all_bars has them all."""
    return last_bars(bridge._daily(spark, d).where("ok % 3 = 0"), bridge.decisions(spark, d))


@query("SELECT d.ticker, d.date, b.date AS bar_date, round(b.close + 1e-9, 6) + 0.0 AS close FROM dec d ASOF JOIN daily b ON d.ticker = b.ticker AND d.date >= b.date")
def j6_asof_all_bars(spark, d):
    """As j6_asof, over every bar."""
    return last_bars(bridge._daily(spark, d), bridge.decisions(spark, d))


@query(f"SELECT ticker, date, {R(f'last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS close FROM (SELECT ticker, date, CASE WHEN ok % 4 <> 0 THEN close END AS x FROM daily)")
def j8_forward_fill(spark, d):
    df = bridge._daily(spark, d).withColumn("x", F.when(F.col("ok") % 4 != 0, F.col("close")))
    return df.select("ticker", "date", *r6(close=filled_forward(F.col("x"))))


@query("SELECT ticker, date, action FROM dec d WHERE EXISTS (SELECT 1 FROM rets r WHERE r.ticker = d.ticker AND r.date = d.date AND r.r > 0) AND EXISTS (SELECT 1 FROM reg g WHERE g.ticker = d.ticker AND g.date = d.date AND g.calm > 0.3)")
def j4_semi(spark, d):
    on = ["ticker", "date"]
    return bridge.decisions(spark, d).select(*on, "action").join(rets(spark, d).where("r > 0").select(*on), on, "left_semi").join(bridge.regimes(spark, d).where("calm > 0.3").select(*on), on, "left_semi")


@query("SELECT ticker, date, key FROM (SELECT ticker, date, sha256(ticker || chr(10) || '----' || chr(10) || CAST(date AS VARCHAR)) AS key FROM daily) a WHERE key NOT IN (SELECT sha256(ticker || chr(10) || '----' || chr(10) || CAST(date AS VARCHAR)) FROM dec)")
def kv1_j5_cache_misses(spark, d):
    keyed = lambda df: df.select("ticker", "date", files.prompt_key(F.col("ticker"), F.col("date").cast("string")).alias("key"))
    return files.missing(keyed(bridge.bars(spark, d)), keyed(bridge.decisions(spark, d)))


@query(f"""SELECT ticker, date, {R(f'close / lag(close, 21) {WIN} - 1')} AS ret_1m, {R('close / first_value(close) OVER (PARTITION BY ticker, year(date) ORDER BY date) - 1')} AS ytd,
 {R("list_sum(list_transform(h, lambda x: CASE WHEN x <= close THEN 1 ELSE 0 END)) / len(h)::DOUBLE")} AS pct_1y FROM (SELECT *, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING) AS h FROM daily)""")
def x1_x3_macro(spark, d):
    ytd = F.first("close").over(W.partitionBy("ticker", F.year("date")).orderBy("date"))
    year = F.collect_list("close").over(by().rowsBetween(-251, 0))
    df = bridge.bars(spark, d).withColumns({"ret_1m": momentum(F.col("close"), 21), "ytd": F.col("close") / ytd - 1, "h": year})
    low = F.size(F.filter("h", lambda x: x <= F.col("close"))) / F.size("h")
    return df.select("ticker", "date", *r6(ret_1m=F.col("ret_1m"), ytd=F.col("ytd"), pct_1y=low))


@query(f", m AS (SELECT ticker, date, close / lag(close, 21) {WIN} - 1 AS m FROM daily) SELECT a.ticker, a.date, {R('a.m - b.m')} AS excess, CAST(row_number() OVER (PARTITION BY a.date ORDER BY round(a.m - b.m, 9) DESC NULLS LAST, a.ticker) AS INT) AS place FROM m a JOIN m b ON a.date = b.date AND b.ticker = '1-URGENT'")
def x4_rotation(spark, d):
    m = bridge.bars(spark, d).select("ticker", "date", momentum(F.col("close"), 21).alias("m"))
    df = m.join(m.where("ticker = '1-URGENT'").select("date", F.col("m").alias("base")), "date").withColumn("x", F.col("m") - F.col("base"))
    place = F.row_number().over(W.partitionBy("date").orderBy(F.round("x", 9).desc_nulls_last(), "ticker"))
    return df.select("ticker", "date", *r6(excess=F.col("x")), place.alias("place"))


@query(f"SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, {R('avg(a.l - b.l)')} AS mean, {R('avg(a.l - b.l) / nullif(sqrt(var_pop(a.l - b.l) / count(*)), 0)')} AS dm FROM (SELECT ticker, date, net ** 2 AS l FROM bt WHERE net IS NOT NULL) a JOIN (SELECT ticker, date, net ** 2 AS l FROM bt WHERE net IS NOT NULL) b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2")
def j10_t5_dm_matrix(spark, d):
    loss = ran(spark, d).where("net is not null").select("ticker", "date", (F.col("net") ** 2).alias("l"))
    a, b = (loss.select(F.col("ticker").alias(x), "date", F.col("l").alias(f"l{x}")) for x in ("a", "b"))
    gap = F.col("la") - F.col("lb")
    pairs = a.join(b, "date").where("a < b").groupBy("a", "b")
    return pairs.agg(F.count("*").alias("n"), *r6(mean=F.avg(gap), dm=F.avg(gap) / F.nullif(F.sqrt(F.var_pop(gap) / F.count("*")), F.lit(0.0))))


@query(f", {DET_SQL} SELECT ticker, count_if(a AND NOT c) AS b, count_if(c AND NOT a) AS c, {R('CASE WHEN count_if(a <> c) >= 25 THEN (abs(count_if(a AND NOT c) - count_if(c AND NOT a)) - 1) ** 2 / count_if(a <> c)::DOUBLE END')} AS stat, count_if(a) AS hits FROM (SELECT ticker, sign(size) = sign(r_next) AS a, sign({MODES['C'][0]}) = sign(r_next) AS c FROM det WHERE r_next IS NOT NULL AND r_next <> 0) GROUP BY ticker")
def t6_t7_mcnemar(spark, d):
    df = supervision.intervene(detected(spark, d), "override", "C").where("r_next is not null and r_next <> 0")
    df = df.select("ticker", (F.signum("size") == F.signum("r_next")).alias("x"), (F.signum("final_size") == F.signum("r_next")).alias("y"))
    out = df.groupBy("ticker").agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(F.col("y") & ~F.col("x")).alias("c"), F.count_if("x").alias("hits"))
    n = F.col("b") + F.col("c")
    return out.select("ticker", "b", "c", *r6(stat=F.when(n >= 25, (F.abs(F.col("b") - F.col("c")) - 1) ** 2 / n)), "hits")


@query(f"SELECT ticker, count(*) AS n, {R('(avg(net) + 0.001) / (stddev_samp(net) / sqrt(count(*)))')} AS t_low, {R('(avg(net) - 0.001) / (stddev_samp(net) / sqrt(count(*)))')} AS t_high, {R('any_value(w_plus)')} AS w_plus FROM (SELECT *, sum(CASE WHEN net > 0 THEN k ELSE 0 END) OVER (PARTITION BY ticker) AS w_plus FROM (SELECT ticker, net, rank() OVER (PARTITION BY ticker ORDER BY round(abs(net), 12)) + (count(*) OVER (PARTITION BY ticker, round(abs(net), 12)) - 1) / 2.0::DOUBLE AS k FROM bt WHERE net IS NOT NULL AND net <> 0)) GROUP BY ticker")
def t9_t10_tost_wilcoxon(spark, d):
    df = ran(spark, d).where("net is not null and net <> 0").withColumn("size", F.round(F.abs("net"), 12))
    df = df.withColumn("k", average_rank(F.col("size"), "ticker"))
    se = F.stddev_samp("net") / F.sqrt(F.count("*"))
    return df.groupBy("ticker").agg(F.count("*").alias("n"), *r6(t_low=(F.avg("net") + 0.001) / se, t_high=(F.avg("net") - 0.001) / se, w_plus=F.sum(F.when(F.col("net") > 0, F.col("k")).otherwise(0.0))))


AVERAGE_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


@query(f"SELECT {R('corr(a, b)')} AS rho, count(*) AS n FROM (SELECT {AVERAGE_RANK.format('m')} AS a, {AVERAGE_RANK.format('s')} AS b FROM (SELECT ticker, avg(r) AS m, stddev_samp(r) AS s FROM rets GROUP BY ticker))")
def m25_spearman(spark, d):
    per = rets(spark, d).groupBy("ticker").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return inference.spearman(per, "m", "s").select(*r6(rho=F.col("rho")), "n")  # one row a ticker


@query("SELECT ticker, max_by(date, abs(net)) AS date, round(max(abs(net)), 6) AS size FROM bt GROUP BY ticker")
def m26_largest_day(spark, d):
    return ran(spark, d).groupBy("ticker").agg(F.max_by("date", F.abs("net")).alias("date"), F.round(F.max(F.abs("net")), 6).alias("size"))


@query(f", {DET_SQL} SELECT ticker, date, {R('gap')} AS gap FROM (SELECT ticker, date, gap, row_number() OVER (PARTITION BY ticker ORDER BY round(gap, 9) DESC, date) AS k FROM (SELECT *, abs(size - ({MODES['ram_continuous'][0]})) AS gap FROM det)) WHERE k = 1 AND gap >= 1e-6")
def x8_case_day(spark, d):
    """The day on which reducing moves the agent's position most, the first of equal ones; none if it never moves."""
    df = supervision.intervene(detected(spark, d), "reduce", reduce="ram_continuous").withColumn("gap", F.abs(F.col("size") - F.col("final_size")))
    k = F.row_number().over(W.partitionBy("ticker").orderBy(F.round("gap", 9).desc(), "date"))
    return df.withColumn("k", k).where("k = 1 and gap >= 1e-6").select("ticker", "date", *r6(gap=F.col("gap")))


@query(f"SELECT ticker, half, {R('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)')} AS sharpe, count(*) AS n FROM (SELECT ticker, net, CASE WHEN row_number() {WIN} <= count(*) OVER (PARTITION BY ticker) // 2 THEN 1 ELSE 2 END AS half FROM bt WHERE net IS NOT NULL) GROUP BY 1, 2")
def m31_half_split(spark, d):
    df = ran(spark, d).where("net is not null")
    half = F.when(F.row_number().over(by()) <= F.floor(F.count("*").over(W.partitionBy("ticker")) / 2), 1).otherwise(2)
    return df.withColumn("half", half).groupBy("ticker", "half").agg(*r6(sharpe=backtest.sharpe(F.col("net"))), F.count("*").alias("n"))


@query(f", e AS (SELECT row_number() OVER (ORDER BY date) - 1 AS pos, date AS t0, coalesce(lead(date) OVER (ORDER BY date), date) AS t1 FROM dec WHERE ticker = '1-URGENT'), n AS (SELECT count(*) AS n FROM e), f(fold, a, b) AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT), a, b FROM range(6) x(a), range(6) y(b) WHERE a < b), g AS (SELECT e.*, (SELECT count(*) FROM range(1, 6) q(i) WHERE e.pos >= n * i // 6) AS g FROM e, n), te AS (SELECT fold, pos, t0, t1 FROM g JOIN f ON g = a OR g = b), env AS (SELECT fold, min(t0) AS lo, max(t1) AS hi FROM te GROUP BY fold) SELECT fold AS fold_id, pos AS row_pos, 'test' AS role FROM te UNION ALL SELECT f.fold, pos, 'train' FROM g, f, n JOIN env ON env.fold = f.fold WHERE g <> a AND g <> b AND NOT (t1 >= lo AND t0 <= hi) AND NOT (pos >= n * (a + 1) // 6 AND pos < n * (a + 1) // 6 + 5) AND NOT (pos >= n * (b + 1) // 6 AND pos < n * (b + 1) // 6 + 5)".replace("JOIN env ON env.fold = f.fold", ", env").replace("WHERE g <> a", "WHERE env.fold = f.fold AND g <> a"))
def v1_v2_purged_folds(spark, d):
    order = W.partitionBy("ticker").orderBy("date")
    events = bridge.decisions(spark, d).where("ticker = '1-URGENT'").select((F.row_number().over(order) - 1).cast("long").alias("row_pos"), F.col("date").alias("t0"), F.coalesce(F.lead("date").over(order), "date").alias("t1"))
    return folds.purged(events)


@query(""", e AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, date AS t0, coalesce(lead(date) OVER (PARTITION BY ticker ORDER BY date), date) AS t1, count(*) OVER (PARTITION BY ticker) AS n FROM dec),
 f AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS fold, a, b FROM range(6) x(a), range(6) y(b) WHERE a < b),
 g AS (SELECT *, CASE WHEN pos >= n * 5 // 6 THEN 5 WHEN pos >= n * 4 // 6 THEN 4 WHEN pos >= n * 3 // 6 THEN 3 WHEN pos >= n * 2 // 6 THEN 2 WHEN pos >= n // 6 THEN 1 ELSE 0 END AS g FROM e),
 te AS (SELECT ticker, fold, pos, t0, t1 FROM g JOIN f ON g = a OR g = b), env AS (SELECT ticker, fold, min(t0) AS lo, max(t1) AS hi FROM te GROUP BY ticker, fold)
 SELECT ticker, fold AS fold_id, pos AS row_pos, 'test' AS role FROM te UNION ALL
 SELECT g.ticker, f.fold, pos, 'train' FROM g JOIN env ON env.ticker = g.ticker JOIN f ON f.fold = env.fold WHERE g <> a AND g <> b AND NOT (t1 >= lo AND t0 <= hi)
  AND NOT (pos >= n * (a + 1) // 6 AND pos < n * (a + 1) // 6 + 5) AND NOT (pos >= n * (b + 1) // 6 AND pos < n * (b + 1) // 6 + 5)""")
def v1_v2_purged_folds_by_ticker(spark, d):
    """As v1_v2_purged_folds, for every ticker."""
    events = bridge.decisions(spark, d).select("ticker", (F.row_number().over(by()) - 1).cast("long").alias("row_pos"), F.col("date").alias("t0"), F.coalesce(F.lead("date").over(by()), "date").alias("t1"))
    return folds.purged_by(events, "ticker")


@query("SELECT ticker, date, fold FROM (SELECT ticker, date, i, n, CASE WHEN i >= n * 4 // 5 THEN 4 WHEN i >= n * 3 // 5 THEN 3 WHEN i >= n * 2 // 5 THEN 2 WHEN i >= n // 5 THEN 1 ELSE 0 END AS fold FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM dec)) WHERE fold = 4 OR i < (fold + 1) * n // 5 - 5")
def v3_fold_ids(spark, d):
    """Contiguous folds; the last rows of each but the last are dropped as embargo."""
    return folds.contiguous(bridge.decisions(spark, d).select("ticker", "date"), "ticker", "date").select("ticker", "date", "fold")


@query(f"SELECT cut, count(*) AS n, {R('avg(CASE WHEN r_next > 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS p_up FROM dl, (SELECT i / 20.0::DOUBLE AS cut FROM range(1, 20) x(i)) WHERE r_next IS NOT NULL AND calm >= cut GROUP BY cut HAVING count(*) > 30")
def c6_flatness(spark, d):
    grid = spark.range(1, 20).select((F.col("id") / F.lit(20.0)).alias("cut"))
    df = labelled(spark, d).where("r_next is not null").crossJoin(F.broadcast(grid)).where("calm >= cut")  # 19 constants
    return df.groupBy("cut").agg(F.count("*").alias("n"), *r6(p_up=F.avg((F.col("r_next") > 0).cast("double")))).where("n > 30")


@query(f"SELECT bin, count(*) AS n, {R('avg(CASE WHEN CASE WHEN calm >= crisis THEN 1 ELSE -1 END = sign(r_next) THEN 1.0::DOUBLE ELSE 0 END)')} AS reliability FROM (SELECT *, CAST(least(9, floor(greatest(calm, crisis) * 10 + 1e-9)) AS INT) AS bin FROM dl WHERE r_next IS NOT NULL AND r_next <> 0) GROUP BY bin")
def c1_c4_reliability(spark, d):
    conf = F.least(F.lit(9), F.floor(F.greatest("calm", "crisis") * 10 + 1e-9)).cast("int")
    right = (F.when(F.col("calm") >= F.col("crisis"), 1.0).otherwise(-1.0) == F.signum("r_next")).cast("double")
    return labelled(spark, d).where("r_next is not null and r_next <> 0").groupBy(conf.alias("bin")).agg(F.count("*").alias("n"), *r6(reliability=F.avg(right)))


STRATEGIES = {"hold": ("1.0::DOUBLE", lambda: F.lit(1.0)), "short": ("-1.0::DOUBLE", lambda: F.lit(-1.0)), "agent": ("size", lambda: F.col("size")), "regime": ("CASE WHEN calm >= crisis THEN 1 ELSE -1 END * 0.1::DOUBLE", lambda: F.when(F.col("calm") >= F.col("crisis"), 1).otherwise(-1) * F.lit(0.1))}


@query(f", s AS ({' UNION ALL '.join(f'''SELECT '{k}' AS strategy, ticker, date, r, {v[0]} AS w FROM dl''' for k, v in STRATEGIES.items())}) SELECT strategy, ticker, count(net) AS n, {R('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)')} AS sharpe, {R('product(1 + net)')} AS final FROM (SELECT strategy, ticker, coalesce(lag(w) OVER (PARTITION BY strategy, ticker ORDER BY date), 0) * r AS net FROM s) GROUP BY 1, 2")
def i9_x6_strategies(spark, d):
    df = labelled(spark, d)
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v[1]().cast("double").alias("w")) for k, v in STRATEGIES.items()])).alias("x")
    long = df.select("ticker", "date", "r", parts).select("ticker", "date", "r", "x.*")
    net = F.coalesce(F.lag("w").over(W.partitionBy("strategy", "ticker").orderBy("date")), F.lit(0.0)) * F.col("r")
    return long.withColumn("net", net).groupBy("strategy", "ticker").agg(F.count("net").alias("n"), *r6(sharpe=backtest.sharpe(F.col("net")), final=F.product(1 + F.col("net"))))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value) + 1e-9, 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def s1_event_windows(spark, d):
    from tidemark.streaming import paths

    out = paths.windowed(spark.read.parquet(f"{d}/events.parquet"))
    return out.select("event_type", F.to_date("window.start").alias("day"), "n", (F.round(F.col("total") + 1e-9, 4) + 0.0).alias("total"))
