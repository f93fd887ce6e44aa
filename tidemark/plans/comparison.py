"""Named queries that set strategies and learners side by side: the learner among the strategies, boards by fold scheme and what
their leaders earn later, direction against sizing, checks left out; smoothed and decoded regimes and the texts that tell them.

A board's fold scheme is `shuffled` (five folds dealt without regard to time, which leak) or `purged` (five stretches with an embargo).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.series import by, filled_forward
from tidemark.operators import folds, learning, recursions, supervision
from tidemark.plans.experiments import (
    _NINE_SQL, CALIBRATION_END, FEATURES_SQL, FLAGS, INPUTS, NINE, PERSONA_FEATURES, VALID,
    calibration, features, figures, inputs, kept, learned, learner_predictions, learner_rows, market, meta_rows, net, nine, performance, points_sql, predictions, purged, supervised,
)
from tidemark.plans.registry import DET_SQL, ONE, WIN, R, detected, matthews, query, r6
from tidemark.sources import bridge


def learner_positions(spark, d) -> DataFrame:
    """ticker, date, p: the meta-learner's out-of-fold probability of each labelled day."""
    got = learning.out_of_fold(predictions(spark, d), "ticker")
    return meta_rows(spark, d).select("ticker", "row_pos", "date").join(got, ["ticker", "row_pos"]).select("ticker", "date", "p")


def ten(spark, d) -> DataFrame:
    """strategy, ticker, date, r, r_next, w, net: nine strategies by calibrated checks, and the meta-learner (long over one half, short
    under it, flat on days without a label), all over the same days."""
    rows = supervised(spark, d).join(learner_positions(spark, d), ["ticker", "date"], "left")
    weights = {k: v[1]() for k, v in NINE.items()} | {"learner": F.coalesce(F.signum(F.col("p") - 0.5), F.lit(0.0))}
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), w.cast("double").alias("w")) for k, w in weights.items()])).alias("x")
    long = rows.select("ticker", "date", "r", "r_next", parts).select("x.strategy", "ticker", "date", "r", "r_next", "x.w")
    return long.withColumn("net", net(F.col("w"), F.col("r"), "strategy"))


@query()
def i9_x6_ten_strategies(spark, d):
    """The table of strategies with the meta-learner among them: ten figures, MCC, and what 1000 have become."""
    rows = ten(spark, d)
    return figures(rows).join(performance(rows, "strategy").select("ticker", "strategy", "mcc", "equity"), ["ticker", "strategy"])


@query()
def i9_learner_quality(spark, d):
    """The meta-learner's mean out-of-fold probabilities: confusion counts at one half, accuracy, MCC, area under the curve, log loss and
    Brier score, and the log loss of its folds."""
    got = predictions(spark, d)
    mean = got.groupBy("ticker", "kind", "row_pos").agg(F.avg("p").alias("p"), F.first("y").alias("y"))
    up, rose = F.col("p") >= 0.5, F.col("y") == 1
    counts = {"tp": up & rose, "fp": up & ~rose, "fn": ~up & rose, "tn": ~up & ~rose}
    table = mean.groupBy("ticker").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.avg((up == rose).cast("double")).alias("accuracy"), matthews(up, rose).alias("mcc"))
    return table.join(learning.board_of(mean, "ticker").select("ticker", "auc", "log_loss", "brier", "n"), "ticker").join(learning.fold_losses(got, "ticker"), "ticker")


@query()
def q10_importance(spark, d):
    """Two states: mean size of each feature's Shapley value over the out-of-fold rows, largest first, and what kind it is."""
    got = learning.importance(learner_predictions(spark, d, 2, True), INPUTS, "ticker")
    return got.withColumn("family", text.family(F.col("feature")))


@query()
def q10_ablation(spark, d):
    """Two states: the meta-learner with all features and with the agent's own alone, by performance and log loss of the folds, and how
    much Sharpe the other features add."""
    rows = learner_rows(spark, d, 2)
    agent = kept(spark, d, "learner_agent", lambda: learning.fold_predictions(rows, purged(rows), PERSONA_FEATURES, "ticker"))
    both = learner_predictions(spark, d, 2, True).withColumn("inputs", F.lit("all")).unionByName(agent.withColumn("inputs", F.lit("agent")))
    mean = both.groupBy("ticker", "inputs", "row_pos").agg(F.signum(F.avg("p") - 0.5).alias("w"))
    done = performance(mean.join(rows.select("ticker", "row_pos", "date", "r", "r_next"), ["ticker", "row_pos"]), "inputs").select("ticker", "inputs", "sharpe", "accuracy", "mcc", "n")
    ground = F.max(F.when(F.col("inputs") == "agent", F.col("sharpe"))).over(W.partitionBy("ticker"))
    return done.join(learning.fold_losses(both, "ticker", "inputs"), ["ticker", "inputs"]).withColumn("gain", F.col("sharpe") - ground)


KINDS = tuple(learning.CANDIDATES | learning.GRID)


def boards(spark, d) -> DataFrame:
    """scheme, ticker, kind, auc, log_loss, brier, n, place: all candidates on calibration days under both fold schemes."""
    rows = calibration(meta_rows(spark, d))
    days, cut = rows.select("ticker", "date"), None
    for scheme, dealt in (("shuffled", folds.shuffled(days, "ticker", "date", 5)), ("purged", folds.contiguous(days, "ticker", "date", 5, 5))):
        one = folds.roles(dealt, "ticker", 5).withColumn("key", F.concat_ws("|", F.lit(scheme), "ticker"))
        cut = one if cut is None else cut.unionByName(one)
    keyed = by_scheme(rows)
    return _schemes(kept(spark, d, "boards", lambda: learning.board_of(learning.fold_predictions(keyed, cut.drop("ticker"), INPUTS, "key", KINDS), "key")))


def by_scheme(rows: DataFrame) -> DataFrame:
    """rows twice, once for each scheme, with key (scheme and ticker)."""
    return rows.withColumn("scheme", F.explode(F.array(F.lit("shuffled"), F.lit("purged")))).withColumn("key", F.concat_ws("|", "scheme", "ticker")).drop("scheme")


def _schemes(df: DataFrame) -> DataFrame:
    at = F.instr("key", "|")
    return df.select(F.expr("substring(key, 1, instr(key, '|') - 1)").alias("scheme"), F.substring("key", at + 1, F.length("key")).alias("ticker"), *[c for c in df.columns if c != "key"])


def leaders(spark, d) -> DataFrame:
    """scheme, ticker, kind, auc of each board's first, with date, r, r_next, market features and p of the test days: the candidate fitted on
    all calibration days."""
    first = boards(spark, d).where("place = 1").select("scheme", "ticker", "kind", "auc")

    def make() -> DataFrame:
        rows = by_scheme(meta_rows(spark, d))
        role = F.when(F.col("date") <= CALIBRATION_END, "train").otherwise("test")
        once_cut = rows.select("key", F.lit(0).alias("fold_id"), "row_pos", role.alias("role"))
        only = first.select(F.concat_ws("|", "scheme", "ticker").alias("key"), "kind")
        return learning.fold_predictions(rows, once_cut, INPUTS, "key", KINDS, only=only)

    got = _schemes(kept(spark, d, "leaders", make)).select("scheme", "ticker", "row_pos", "p")
    days = meta_rows(spark, d).select("ticker", "row_pos", "date", "r", "r_next", "garch_sigma", "calm_prob", "stress_prob", "crisis_prob")
    return got.join(days, ["ticker", "row_pos"]).join(first, ["scheme", "ticker"])


@query()
def q16_leaderboards(spark, d):
    """The ten best candidates of each ticker under each fold scheme, on calibration days."""
    return boards(spark, d).where("place <= 10")


@query()
def q16_cv_auc_against_sharpe(spark, d):
    """The cross-validated area of each board's leader beside what its direction earns on the test days."""
    rows = leaders(spark, d).withColumn("w", F.signum(F.col("p") - 0.5))
    later = performance(rows, "scheme").select("ticker", "scheme", "sharpe", "accuracy", "mcc", "n")
    return boards(spark, d).where("place = 1").select("scheme", "ticker", "kind", "auc").join(later, ["scheme", "ticker"])


def cells(spark, d) -> DataFrame:
    """strategy (scheme and sizing), ticker, date, r, r_next, w, net: both leaders' direction on the test days under four sizings. regime:
    nothing on days whose likeliest state is crisis; volatility: a tenth over the volatility, one at most; both: both."""
    calm = F.when((F.col("crisis_prob") > F.col("calm_prob")) & (F.col("crisis_prob") > F.col("stress_prob")), 0.0).otherwise(1.0)
    bound = supervision.gso_bound(F.col("garch_sigma"))
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("sizing"), x.alias("size")) for n, x in (("none", F.lit(1.0)), ("volatility", bound), ("regime", calm), ("both", bound * calm))])).alias("x")
    long = leaders(spark, d).select("ticker", "date", "r", "r_next", F.signum(F.col("p") - 0.5).alias("side"), "scheme", sizes)
    long = long.select(F.concat_ws("|", "scheme", "x.sizing").alias("strategy"), "ticker", "date", "r", "r_next", (F.col("side") * F.col("x.size")).alias("w"))
    return long.withColumn("net", net(F.col("w"), F.col("r"), "strategy"))


@query()
def x7_sizing_ablation(spark, d):
    """Direction against sizing: the leader of shuffled and of purged folds, with and without sizing. Sharpe, drawdown, mean size and days
    without a position on the test days."""
    rows = cells(spark, d)
    sizes = rows.groupBy("strategy", "ticker").agg(F.avg(F.abs("w")).alias("mean_size"), F.count_if(F.col("w") == 0).alias("flat_days"))
    out = figures(rows).select("strategy", "ticker", "n", "sharpe", "max_drawdown").join(sizes, ["strategy", "ticker"])
    x = F.split("strategy", "[|]")
    return out.select("ticker", x[0].alias("scheme"), x[1].alias("sizing"), "n", "sharpe", "max_drawdown", "mean_size", "flat_days")


@query()
def x7_sizing_deltas(spark, d):
    """What each part of the difference makes: Sharpe lost by purged instead of shuffled folds (without sizing), by sizing
    (with either direction), and by keeping out of crisis days (with the purged direction)."""
    of = lambda scheme, sizing: F.max(F.when((F.col("scheme") == scheme) & (F.col("sizing") == sizing), F.coalesce("sharpe", F.lit(0.0))))
    return x7_sizing_ablation(spark, d).groupBy("ticker").agg(
        (of("shuffled", "none") - of("purged", "none")).alias("folds_without_sizing"), (of("shuffled", "none") - of("shuffled", "both")).alias("sizing_shuffled"),
        (of("purged", "none") - of("purged", "both")).alias("sizing_purged"), (of("purged", "none") - of("purged", "regime")).alias("regime_purged"),
    )


_PAIRS_SQL = "CAST(count(*) AS BIGINT) AS n, " + R("avg(b.net - a.net) / nullif(sqrt(var_pop(b.net - a.net) / count(*)), 0)") + " AS dm"


@query(f", {_NINE_SQL} SELECT a.ticker, a.strategy AS first, b.strategy AS second, {_PAIRS_SQL} FROM ln a JOIN ln b ON a.ticker = b.ticker AND a.date = b.date AND a.strategy < b.strategy WHERE a.net IS NOT NULL AND b.net IS NOT NULL GROUP BY 1, 2, 3")
def x7_dm_matrix(spark, d):
    """The Diebold-Mariano statistic of every pair of strategies, by one sorted pass over the days: all weights of a day meet in its row."""
    days = nine(spark, d).where("net is not null").groupBy("ticker", "date").agg(F.array_sort(F.collect_list(F.struct("strategy", "net"))).alias("s"))  # nine a day
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["strategy"] > a["strategy"]), lambda b: F.struct(a["strategy"].alias("first"), b["strategy"].alias("second"), (b["net"] - a["net"]).alias("gap")))))
    gap = F.col("x.gap")
    out = days.select("ticker", F.explode(pairs).alias("x")).groupBy("ticker", "x.first", "x.second")
    return out.agg(F.count("*").alias("n"), *r6(dm=F.avg(gap) / F.nullif(F.sqrt(F.var_pop(gap) / F.count("*")), F.lit(0.0))))


def _left_out_sql(mode: str, on: set) -> str:
    ro, po, go = (c if x in on else "0" for c, x in (("ro", "ram"), ("po", "psa"), ("go", "gso")))
    if mode == "reduce":
        return f"size * (1 - [0, 0.25, 0.6, 1][greatest({ro}, {po}, {go}) + 1])"
    return f"CASE WHEN {po} = 3 THEN 0.5 ELSE 1 END * CASE WHEN {ro} >= 2 THEN rs * bound ELSE {ONE} END"


_LEFT_OUT = " UNION ALL ".join(f"SELECT '{m}' AS mode, '{n}' AS enabled, ticker, date, r, ({_left_out_sql(m, on)})::DOUBLE AS w FROM det" for m in ("reduce", "override") for n, on in FLAGS.items())
_LAG = "coalesce(lag(w, {}) OVER (PARTITION BY mode, enabled, ticker ORDER BY date), 0)"
_SHARPE = "avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)"


@query(f", {DET_SQL}, lo AS ({_LEFT_OUT}), ln AS (SELECT *, {_LAG.format(1)} * r - 0.0001::DOUBLE * abs({_LAG.format(1)} - {_LAG.format(2)}) AS net FROM lo), sh AS (SELECT mode, enabled, ticker, count(net) AS n, {_SHARPE} AS s FROM ln GROUP BY 1, 2, 3) SELECT a.mode, a.enabled, a.ticker, CAST(a.n AS BIGINT) AS n, {R('a.s')} AS sharpe, {R('a.s - b.s')} AS gain FROM sh a JOIN sh b ON a.mode = b.mode AND a.ticker = b.ticker AND b.enabled = 'all'")
def q16_ablation_sharpe(spark, d):
    """Sharpe of reduction and override with some of the checks off, and its difference from all checks: one pass over the decisions.
    The volatility check bounds sizes under override even where it is off."""
    points = [F.struct(F.lit(m).alias("mode"), F.lit(n).alias("enabled"), *[F.lit(x in on or (m, x) == ("override", "gso")).alias(f"on_{x}") for x in ("ram", "psa", "gso")]) for m in ("reduce", "override") for n, on in FLAGS.items()]
    rows = detected(spark, d).select("*", F.explode(F.array(*points)).alias("g")).select("*", "g.*").drop("g")
    rows = rows.withColumns({f"{x}_severity": F.when(F.col(f"on_{x}"), F.col(f"{x}_severity")).otherwise("none") for x in ("ram", "psa", "gso")})
    w = F.when(F.col("mode") == "reduce", supervision.decided("reduce")[0]).otherwise(supervision.decided("override", "C")[0])
    rows = rows.withColumn("w", w.cast("double"))
    x = net(F.col("w"), F.col("r"), "mode", "enabled")
    got = rows.select("mode", "enabled", "ticker", x.alias("net")).groupBy("mode", "enabled", "ticker").agg(F.count("net").alias("n"), (F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * 252**0.5).alias("s"))
    ground = F.max(F.when(F.col("enabled") == "all", F.col("s"))).over(W.partitionBy("mode", "ticker"))
    return got.withColumn("gain", F.col("s") - ground).select("mode", "enabled", "ticker", "n", *r6(sharpe=F.col("s"), gain=F.col("gain")))


def _best(*x: str) -> str:
    return f"CASE WHEN {x[0]} >= {x[1]} AND {x[0]} >= {x[2]} THEN 0 WHEN {x[1]} >= {x[2]} THEN 1 ELSE 2 END"


_MOVE = recursions.HMM["trans"]
_WAYS = ", ".join(f"v.b{i} + {float(np.log(_MOVE[i, j]))}::DOUBLE AS w{i}{j}" for i in range(3) for j in range(3))
_BACK = ", ".join(f"{' + '.join(f'{float(_MOVE[i, j])}::DOUBLE * ex.e{j} * be.k{j}' for j in range(3))} AS u{i}" for i in range(3))
#: Recursive CTEs over FEATURES_SQL: vf, the likeliest path to each state of a row; vb, the path; be, what later rows say.
PATH_SQL = f"""vn AS (SELECT ticker, max(i) AS n FROM de GROUP BY ticker),
 vf AS (SELECT ticker, date, i, l0 AS b0, l1 AS b1, l2 AS b2, 0 AS c0, 0 AS c1, 0 AS c2 FROM de WHERE i = 1
  UNION ALL SELECT ticker, date, i, {', '.join(f'greatest(w0{j}, w1{j}, w2{j}) + l{j}' for j in range(3))}, {', '.join(_best(*(f'w{i}{j}' for i in range(3))) for j in range(3))}
   FROM (SELECT de.ticker, de.date, de.i, de.l0, de.l1, de.l2, {_WAYS} FROM vf v JOIN de ON de.ticker = v.ticker AND de.i = v.i + 1)),
 vb AS (SELECT ticker, date, i, s, [c0, c1, c2][s + 1] AS c FROM (SELECT vf.*, {_best('b0', 'b1', 'b2')} AS s FROM vf JOIN vn ON vn.ticker = vf.ticker AND vn.n = vf.i)
  UNION ALL SELECT vf.ticker, vf.date, vf.i, vb.c, [vf.c0, vf.c1, vf.c2][vb.c + 1] FROM vb JOIN vf ON vf.ticker = vb.ticker AND vf.i = vb.i - 1),
 be AS (SELECT vn.ticker, vn.n AS i, 1.0::DOUBLE AS k0, 1.0::DOUBLE AS k1, 1.0::DOUBLE AS k2 FROM vn
  UNION ALL SELECT ticker, i, u0 / (u0 + u1 + u2), u1 / (u0 + u1 + u2), u2 / (u0 + u1 + u2) FROM (SELECT be.ticker, be.i - 1 AS i, {_BACK} FROM be JOIN ex ON ex.ticker = be.ticker AND ex.i = be.i WHERE be.i > 1))"""
_TOTAL = "(calm * k0 + stress * k1 + crisis * k2)"


@query(f", {FEATURES_SQL}, {PATH_SQL} SELECT hm.ticker, hm.date, {R(f'calm * k0 / {_TOTAL}')} AS smooth_calm, {R(f'stress * k1 / {_TOTAL}')} AS smooth_stress, {R(f'crisis * k2 / {_TOTAL}')} AS smooth_crisis, CAST(vb.s AS BIGINT) AS state FROM hm JOIN be ON be.ticker = hm.ticker AND be.i = hm.i JOIN vb ON vb.ticker = hm.ticker AND vb.i = hm.i")
def st6_st7_smoothed_path(spark, d):
    """Smoothed probabilities and the likeliest path, by a model with fixed parameters."""
    out = recursions.regimes(inputs(spark, d).select("ticker", "date", "r", "rv"))
    return out.select("ticker", "date", *r6(**{f"smooth_{c}": F.col(f"smooth_{c}") for c in ("calm", "stress", "crisis")}), "state")


_SPAN = f"CASE WHEN vb.date <= DATE '{CALIBRATION_END}' THEN 'calibration' ELSE 'test' END"


@query(f", {FEATURES_SQL}, {PATH_SQL}, tl AS (SELECT vb.ticker, vb.date, CAST(vb.s AS BIGINT) AS state, f.close, {_SPAN} AS span FROM vb JOIN f USING (ticker, date)) SELECT ticker, date, state, printf('%.2f', close + 1e-9) AS close, span, {R('count(*) OVER (PARTITION BY ticker, span, state)::DOUBLE / count(*) OVER (PARTITION BY ticker, span)')} AS occupancy FROM tl")
def q14_occupancy_by_span(spark, d):
    """State of each day, price carried forward, and the share of its state in its span."""
    states = recursions.regimes(inputs(spark, d).select("ticker", "date", "r", "rv")).select("ticker", "date", "state")
    span = F.when(F.col("date") <= CALIBRATION_END, "calibration").otherwise("test")
    out = states.join(features(spark, d).select("ticker", "date", "close"), ["ticker", "date"], "left").withColumns({"close": filled_forward(F.col("close")), "span": span})
    share = F.count("*").over(W.partitionBy("ticker", "span", "state")) / F.count("*").over(W.partitionBy("ticker", "span"))
    return out.select("ticker", "date", "state", F.format_string("%.2f", F.col("close") + 1e-9).alias("close"), "span", *r6(occupancy=share))


@query(f", {FEATURES_SQL}, {PATH_SQL}, rn AS (SELECT ticker, i, s, r FROM vb JOIN f USING (ticker, date)), st AS (SELECT ticker, s, count(*) AS n, avg(r) AS m, stddev_pop(r) AS sd FROM rn GROUP BY 1, 2), mv AS (SELECT a.ticker, a.s, count(*) AS outgoing, count_if(a.s = b.s) AS stayed FROM rn a JOIN rn b ON b.ticker = a.ticker AND b.i = a.i + 1 GROUP BY 1, 2) SELECT ticker, CAST(s AS BIGINT) AS state, n, {R('n / sum(n) OVER (PARTITION BY ticker)::DOUBLE')} AS occupancy, {R('m')} AS mean, {R('sd')} AS sd, {R('stayed / outgoing::DOUBLE')} AS stay, {R('CASE WHEN stayed < outgoing THEN outgoing / (outgoing - stayed)::DOUBLE END')} AS duration FROM st LEFT JOIN mv USING (ticker, s)")
def st8_m17_path_durations(spark, d):
    """Occupancy of the decoded states, returns within them, how often a state follows itself, and the duration that this makes (null for a
    state that is never left)."""
    path = recursions.regimes(inputs(spark, d).select("ticker", "date", "r", "rv")).select("ticker", "state", "r", F.lead("state").over(by()).alias("then"))
    same = F.count_if(F.col("then") == F.col("state"))
    out = path.groupBy("ticker", "state").agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), same.alias("stayed"), F.nullif(F.count("then"), F.lit(0)).alias("outgoing"))
    stay = F.col("stayed") / F.col("outgoing")
    duration = F.when(F.col("stayed") < F.col("outgoing"), F.col("outgoing") / (F.col("outgoing") - F.col("stayed")))
    return out.select("ticker", "state", "n", *r6(occupancy=F.col("n") / F.sum("n").over(W.partitionBy("ticker")), mean=F.col("m"), sd=F.col("s"), stay=stay, duration=duration))


_FAR = "round(calm, 6) + 1e-9 AS calm, round(stress, 6) + 1e-9 AS stress, round(crisis, 6) + 1e-9 AS crisis, round(sigma, 6) + 1e-9 AS sigma"
_LEVERAGE_SQL = f"""sd AS (SELECT vf.ticker, vf.date, {_best('b0', 'b1', 'b2')} AS s FROM vf),
 lv AS (SELECT ticker, CASE WHEN c > 0 AND x < 0 THEN 1 WHEN c < 0 AND x > 0 THEN -1 END AS leverage FROM (SELECT ticker, avg(CASE WHEN s = 0 THEN f.r END) AS c, avg(CASE WHEN s = 2 THEN f.r END) AS x FROM sd JOIN f USING (ticker, date) WHERE date <= DATE '{CALIBRATION_END}' GROUP BY ticker))"""


@query(f""", {FEATURES_SQL}, {PATH_SQL}, {_LEVERAGE_SQL} SELECT ticker, date, 'State of the market today, as information and not as advice:' || chr(10) || '- Regime probabilities: calm ' || printf('%.2f', calm) || ', stress ' || printf('%.2f', stress) || ', crisis ' || printf('%.2f', crisis) || ' (most likely path: ' || s || ').' || chr(10) || '- Volatility forecast, a year: ' || printf('%.1f%%', sigma * 100) || '.' || chr(10) || '- Largest position within a volatility budget of 10% a year: ' || printf('%.2f', least(1, 0.10 / sigma)) || '.' || CASE leverage WHEN 1 THEN chr(10) || 'In calibration, mean returns were positive in calm and negative in crisis.' WHEN -1 THEN chr(10) || 'In calibration, mean returns were negative in calm and positive in crisis.' ELSE '' END AS text
 FROM (SELECT ms.ticker, ms.date, {_FAR}, s, leverage FROM ms JOIN sd USING (ticker, date) LEFT JOIN lv USING (ticker))""")
def f21_statistics_text_with_state(spark, d):
    """The day's regime and volatility in neutral words, with the state that the likeliest path up to the day ends in (no later row has a
    say) and how returns and regimes went together on calibration days."""
    ends = recursions.decoded_so_far(inputs(spark, d).select("ticker", "date", "r", "rv")).select("ticker", "date", "r", "state")
    mean = lambda s: F.avg(F.when(F.col("state") == s, F.col("r")))
    sign = calibration(ends).groupBy("ticker").agg(mean(0).alias("c"), mean(2).alias("x"))
    sign = sign.select("ticker", F.when((F.col("c") > 0) & (F.col("x") < 0), 1).when((F.col("c") < 0) & (F.col("x") > 0), -1).alias("leverage"))
    rows = market(spark, d).join(ends.select("ticker", "date", "state"), ["ticker", "date"]).join(sign, "ticker", "left")
    c = {n: F.round(n, 6) + 1e-9 for n in ("calm", "stress", "crisis", "sigma")}
    words = text.statistics_text(c["calm"], c["stress"], c["crisis"], F.col("state"), c["sigma"], F.least(F.lit(1.0), 0.10 / c["sigma"]), F.col("leverage"))
    return rows.select("ticker", "date", words.alias("text"))


_SIGNALS = f"""s AS (SELECT ticker, date, row_number() {WIN} AS i, size AS x FROM dec), {points_sql('s')},
 g AS (SELECT ticker, date, i, size - lag(size) {WIN} AS x FROM (SELECT *, row_number() {WIN} AS i FROM dec)), gs AS (SELECT ticker, date, i - 1 AS i, x FROM g WHERE i > 1), {points_sql('gs', 'gb')},
 lv AS (SELECT s.ticker, s.date, s.i, round(b.cp, 9) AS cp, CAST(b.best AS BIGINT) AS best FROM s JOIN b USING (ticker, i)),
 dv AS (SELECT s.ticker, s.date, s.i, round(coalesce(gb.cp, 0), 9) AS cp, CAST(coalesce(gb.best, 0) AS BIGINT) AS best FROM s LEFT JOIN gb ON gb.ticker = s.ticker AND gb.i = s.i - 1 AND gb.i > 0)"""


@query(f", {_SIGNALS} SELECT ticker, date, 'cp_prob' AS signal, {R('CASE WHEN i >= 7 THEN cp ELSE 0 END')} AS psa, best AS map_run_length, i >= 7 AS psa_ready FROM lv UNION ALL SELECT ticker, date, 'cp_prob_delta', {R('CASE WHEN i >= 8 THEN cp ELSE 0 END')}, best, i >= 8 FROM dv UNION ALL SELECT ticker, date, 'map_runlength', {R('CASE WHEN i >= 7 THEN greatest(0, 5 - best) / 5.0::DOUBLE ELSE 0 END')}, best, i >= 7 FROM lv")
def d2_sizing_scores(spark, d):
    """Scores of the sizing check by each of its signals: levels, increments, run length. The run length comes from the levels' pass."""
    base = bridge.decisions(spark, d).select("ticker", "date", "size")
    level, delta = (recursions.sizing_anomaly(base, signal=s) for s in ("cp_prob", "cp_prob_delta"))
    run = F.when(F.col("psa_ready"), F.greatest(F.lit(0), 5 - F.col("map_run_length")) / 5).otherwise(0.0)
    two = F.explode(F.array(F.struct(F.lit("cp_prob").alias("signal"), F.col("psa").alias("score")), F.struct(F.lit("map_runlength").alias("signal"), run.alias("score")))).alias("x")
    one = level.select("ticker", "date", two, "map_run_length", "psa_ready").select("ticker", "date", "x.*", "map_run_length", "psa_ready")
    both = one.unionByName(delta.select("ticker", "date", F.lit("cp_prob_delta").alias("signal"), F.col("psa").alias("score"), "map_run_length", "psa_ready"))
    return both.select("ticker", "date", "signal", *r6(psa=F.col("score")), "map_run_length", "psa_ready")
