"""Fitted models as tables: one row a ticker and number of states. Fits run in parallel, one task a fit; nothing is collected."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.functions.series import spread
from tidemark.operators import inference

SEEDS = tuple(range(42, 52))
#: Where the folds of held-out selection begin, as shares of the series; each is a tenth of it, the last reaches the end.
FOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
LEAST_BLOCK = 30
REGIME = "ticker string, k int, seed int, loglik double, n long, start array<double>, trans array<double>, means array<double>, covs array<double>, centre array<double>, spread array<double>"
VOLATILITY = "ticker string, mu double, omega double, alpha double, beta double, nu double, loglik double, var double, shock double"
ARRAYS = ("start", "trans", "means", "covs", "centre", "spread")


def _row(ticker: str, k: int, n: int, m: dict) -> dict:
    return {"ticker": ticker, "k": k, "seed": m["seed"], "loglik": m["loglik"], "n": n} | {c: np.asarray(m[c]).ravel().tolist() for c in ARRAYS}


def model_of(row) -> dict:
    """A row of a model table as the arrays that the kernels take."""
    k, d = int(row["k"]), len(row["centre"])
    shapes = {"start": (k,), "trans": (k, k), "means": (k, d), "covs": (k, d, d), "centre": (d,), "spread": (d,)}
    return {c: np.array(row[c], dtype=float).reshape(s) for c, s in shapes.items()}


def regime_starts(inputs: DataFrame, ks: tuple[int, ...] = (2, 3), seeds: tuple[int, ...] = SEEDS, spread_out: bool = False) -> DataFrame:
    """ticker, k, seed, loglik, ...: the model of every start that succeeds. inputs: ticker, date, r, rv, without nulls; states are
    ordered by the mean of rv. spread_out: means start from k-means instead of random rows."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, k = rows.sort_values("date", kind="stable")[["r", "rv"]].to_numpy(dtype=float), int(rows["k"].iloc[0])
        if len(x) <= 2 * k:
            return pd.DataFrame(columns=[c.split()[0] for c in REGIME.split(", ")])
        return pd.DataFrame([_row(rows["ticker"].iloc[0], k, len(x), m) for m in kernels.hmm_fits(x, k, list(seeds), spread_out=spread_out)], columns=[c.split()[0] for c in REGIME.split(", ")])

    each = inputs.select("ticker", "date", "r", "rv", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return spread(each, "ticker", "k").groupBy("ticker", "k").applyInPandas(fit, REGIME)


def fit_regimes(inputs: DataFrame, ks: tuple[int, ...] = (2, 3), seeds: tuple[int, ...] = SEEDS, spread_out: bool = False) -> DataFrame:
    """The most likely of the starts of each ticker and number of states, the first among equals."""
    names = [c.split()[0] for c in REGIME.split(", ")]
    best = F.max_by(F.struct(*names), F.struct("loglik", -F.col("seed")))
    return regime_starts(inputs, ks, seeds, spread_out).groupBy("ticker", "k").agg(best.alias("m")).select("m.*")


def apply_regimes(inputs: DataFrame, models: DataFrame, *keep: str) -> DataFrame:
    """ticker, k, keep, date, calm, stress, crisis, state: filtered probabilities of each model of the row's ticker.

    calm is the state of the least volatility, crisis that of the most, stress what lies between; keep: columns of models that
    tell its rows apart (beside k). state is the Viterbi state, which depends on later rows; the probabilities do not.
    """
    extra = [f"{c} {models.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join(["ticker string", "k int", *extra, "date date", "calm double", "stress double", "crisis double", "state int"])

    def run(rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("date", kind="stable"), []
        x = rows[["r", "rv"]].to_numpy(dtype=float)
        for _, f in fitted.iterrows():
            m = model_of(f)
            dens = kernels.log_gauss((x - m["centre"]) / m["spread"], m["means"], m["covs"])
            now = kernels.hmm_filter(dens, m["start"], m["trans"])
            out.append(pd.DataFrame({"ticker": f["ticker"], "k": f["k"], **{c: f[c] for c in keep}, "date": rows["date"], "calm": now[:, 0], "stress": now[:, 1:-1].sum(axis=1), "crisis": now[:, -1], "state": kernels.viterbi(dens, m["start"], m["trans"])}))
        return pd.concat(out) if out and len(rows) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    asked = models.select("ticker", "k", *keep, *ARRAYS)
    return inputs.select("ticker", "date", "r", "rv").groupBy("ticker").cogroup(asked.groupBy("ticker")).applyInPandas(run, schema)


def transitions(models: DataFrame) -> DataFrame:
    """ticker, k, state, stay, duration (expected days in it; null if it is never left), and the row of the transition matrix."""
    rows = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda s: F.struct(s.alias("state"), F.slice("trans", s * F.col("k") + 1, F.col("k")).alias("row")))
    out = models.select("ticker", "k", F.explode(rows).alias("x")).select("ticker", "k", "x.state", "x.row")
    stay = F.element_at("row", F.col("state") + 1)
    return out.withColumn("stay", stay).withColumn("duration", F.when(F.col("stay") < 1, 1 / (1 - F.col("stay"))))


def criteria(models: DataFrame, dims: int = 2) -> DataFrame:
    """ticker, k, n, loglik, free, aic, bic of each model (full covariances)."""
    k = F.col("k")
    free = (k - 1) + k * (k - 1) + k * dims + k * (dims * (dims + 1) // 2)
    return models.select("ticker", "k", "n", "loglik", free.alias("free")).select(
        "*", (2 * F.col("free") - 2 * F.col("loglik")).alias("aic"), (F.col("free") * F.log(F.col("n").cast("double")) - 2 * F.col("loglik")).alias("bic")
    )


def fit_volatility(returns: DataFrame) -> DataFrame:
    """Parameters of each ticker's variance model, fitted on returns (ticker, date, r; nulls left out), and the end of its path."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values("date", kind="stable")["r"].dropna().to_numpy(dtype=float)
        names = [c.split()[0] for c in VOLATILITY.split(", ")]
        return pd.DataFrame([{"ticker": rows["ticker"].iloc[0]} | kernels.garch_fit(r)], columns=names) if len(r) > 10 else pd.DataFrame(columns=names)

    return spread(returns.select("ticker", "date", "r"), "ticker").groupBy("ticker").applyInPandas(fit, VOLATILITY)


def apply_volatility(returns: DataFrame, params: DataFrame) -> DataFrame:
    """ticker, date, sigma: the path that goes on from where the fit ended, one step before each return is seen."""

    def run(rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(fitted):
            return pd.DataFrame(columns=["ticker", "date", "sigma"])
        rows, f = rows.sort_values("date", kind="stable"), fitted.iloc[0]
        path = kernels.garch_path(rows["r"].to_numpy(dtype=float), **{c: float(f[c]) for c in ("mu", "omega", "alpha", "beta", "var", "shock")})
        return pd.DataFrame({"ticker": rows["ticker"], "date": rows["date"], "sigma": path})

    fine = returns.select("ticker", "date", "r").where("r is not null")
    return fine.groupBy("ticker").cogroup(params.groupBy("ticker")).applyInPandas(run, "ticker string, date date, sigma double")


def _folds(inputs: DataFrame, ks: tuple[int, ...], *more: str) -> DataFrame:
    """The rows of each ticker once for each k and fold, with n and i (from 0)."""
    n, i = F.count("*").over(W.partitionBy("ticker")), F.row_number().over(W.partitionBy("ticker").orderBy("date")) - 1
    grid = [F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("fold")) for k in ks for f in range(len(FOLDS))])).alias("g")]
    out = inputs.select("ticker", "date", "r", "rv", *more, n.alias("n"), i.alias("i")).select("*", *grid).select("*", "g.k", "g.fold").drop("g")
    return out.where(F.col("i") < _end(F.col("fold"), F.col("n")))


def _end(fold, n):
    return F.when(fold == len(FOLDS) - 1, n).otherwise(F.floor((F.element_at(F.array(*map(F.lit, FOLDS)), fold + 1) + 0.1) * n))


def _cut(rows: pd.DataFrame) -> tuple[pd.DataFrame, int, int, int]:
    rows = rows.sort_values("date", kind="stable")
    return rows, int(rows["k"].iloc[0]), int(FOLDS[int(rows["fold"].iloc[0])] * int(rows["n"].iloc[0])), len(rows)


def heldout_loglik(inputs: DataFrame, ks: tuple[int, ...] = (2, 3), seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """ticker, k, loglik (mean of the folds' log-likelihood a row of the block after the fit), folds. Blocks under 30 rows are skipped."""

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows, k, a, b = _cut(rows)
        out = pd.DataFrame({"ticker": [rows["ticker"].iloc[0]], "k": [k], "ll": [0.0]})
        x = rows[["r", "rv"]].to_numpy(dtype=float)
        found = kernels.hmm_fits(x[:a], k, list(seeds)) if b - a >= LEAST_BLOCK else []
        if not found:
            return out.iloc[:0]
        m = max(found, key=lambda v: v["loglik"])
        dens = kernels.log_gauss((x[a:] - m["centre"]) / m["spread"], m["means"], m["covs"])
        return out.assign(ll=kernels.hmm_loglik(dens, m["start"], m["trans"]) / (b - a))

    each = spread(_folds(inputs, ks), "ticker", "k", "fold").groupBy("ticker", "k", "fold").applyInPandas(score, "ticker string, k int, ll double")
    return each.groupBy("ticker", "k").agg(F.avg("ll").alias("loglik"), F.count("*").alias("folds"))


def directional(inputs: DataFrame, ks: tuple[int, ...] = (2, 3), seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """ticker, k, sharpe, accuracy, active: a position of 1 in the state of least volatility, -1 in that of the most, 0 between,
    by filtered probabilities on the blocks after each fit. inputs also holds r_next; rows without it earn nothing. The deviation is that
    of the population."""

    def positions(rows: pd.DataFrame) -> pd.DataFrame:
        rows, k, a, b = _cut(rows)
        x = rows[["r", "rv"]].to_numpy(dtype=float)
        found = kernels.hmm_fits(x[:a], k, list(seeds)) if b - a >= LEAST_BLOCK else []
        out = pd.DataFrame({"ticker": rows["ticker"], "k": k, "position": 0.0, "r_next": rows["r_next"]}).iloc[a:]
        if not found:
            return out.iloc[:0]
        m = max(found, key=lambda v: v["loglik"])
        now = kernels.hmm_filter(kernels.log_gauss((x - m["centre"]) / m["spread"], m["means"], m["covs"]), m["start"], m["trans"])[a:].argmax(axis=1)
        return out.assign(position=np.where(now == 0, 1.0, np.where(now == k - 1, -1.0, 0.0)))

    each = spread(_folds(inputs, ks, "r_next"), "ticker", "k", "fold").groupBy("ticker", "k", "fold").applyInPandas(positions, "ticker string, k int, position double, r_next double")
    each = each.where("r_next is not null and not isnan(r_next)").withColumn("pnl", F.col("position") * F.col("r_next"))
    hit = F.avg(F.when(F.col("position") != 0, (F.signum("position") == F.signum("r_next")).cast("double")))
    sharpe = F.avg("pnl") / F.nullif(F.stddev_pop("pnl"), F.lit(0.0)) * 252**0.5
    return each.groupBy("ticker", "k").agg(sharpe.alias("sharpe"), hit.alias("accuracy"), F.count_if(F.col("position") != 0).alias("active"))


def best_k(table: DataFrame, value: str, key: str = "ticker", share: str | None = None, least: float = 0.05, tie: float = 1e-9) -> DataFrame:
    """key, k: the number of states of the largest value, the least one within `tie` of it. share: a column that must reach
    `least`; where no row of a key does, all count."""
    able = table.where(F.col(value).isNotNull() & ~F.isnan(value))
    if share:
        fits = (F.col(share) >= least).cast("int")
        able = able.withColumn("fits", fits).withColumn("most", F.max("fits").over(W.partitionBy(key))).where("fits = most")
    top = F.max(value).over(W.partitionBy(key))
    return able.withColumn("top", top).where(F.col(value) >= F.col("top") - tie).groupBy(key).agg(F.min("k").alias("k"))


def write_version(models: DataFrame, path: str, version: int) -> None:
    """Keep a model table under its version; the versions before stay, as the backup of what it replaces."""
    models.write.mode("errorifexists").parquet(f"{path}/version={int(version)}")


def read_version(spark, path: str, version: int | None = None) -> DataFrame:
    """A version of a model table, the last one if none is named."""
    whole = spark.read.parquet(path)
    wanted = whole.agg(F.max("version")).first()[0] if version is None else version
    return whole.where(F.col("version") == wanted).drop("version")


def _entries(spark, path: str) -> dict[int, str]:
    """The versions that have been published: number and the folder of each."""
    jvm = spark.sparkContext._jvm
    log = jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    fs = log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(log):
        return {}
    found = {}
    for status in fs.listStatus(log):
        stream = fs.open(status.getPath())
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        name = status.getPath().getName()
        if name.isdigit() and text.endswith(";"):  # one that was not written to its end does not count
            found[int(name)] = text[:-1]
    return found


def publish(models: DataFrame, path: str) -> int:
    """Write a model table as the next version and give its number. The table comes first, the entry that names it last, so a
    reader sees the version before or this one whole; versions before stay. Of two writers of one number one fails."""
    spark = models.sparkSession
    folder = f"tables/{uuid.uuid4().hex}"
    models.write.mode("errorifexists").parquet(f"{path}/{folder}")
    number = max(_entries(spark, path), default=0) + 1
    entry = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/log/{number:012}")
    stream = entry.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(entry, False)
    stream.write(bytearray(f"{folder};".encode()))
    stream.close()
    return number


def published(spark, path: str, version: int | None = None) -> DataFrame:
    """A published version of a model table, the last one if none is named."""
    entries = _entries(spark, path)
    if not entries or version is not None and version not in entries:
        raise ValueError(f"no version {version or ''} under {path}")
    return spark.read.parquet(f"{path}/{entries[max(entries) if version is None else version]}")


def same_parameters(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("ticker",), names: tuple[str, ...] = ("omega", "alpha", "beta", "nu"), within: float = 1e-6) -> DataFrame:
    """keys, same: whether no parameter differs by `within` or more; a key that one of the tables lacks is not the same."""
    left, right = (t.select(*keys, F.struct(*names).alias(a)) for t, a in ((old, "x"), (new, "y")))
    close = reduce(lambda a, b: a & b, [F.abs(F.col(f"x.{n}") - F.col(f"y.{n}")) < within for n in names])
    return left.join(right, list(keys), "full").select(*keys, F.coalesce(close, F.lit(False)).alias("same"))


def calibrate_gates(days: DataFrame, *key: str) -> DataFrame:
    """key, tau: the isotonic gate of days (key, calm, crisis, r_next), one half where the reliability never crosses it."""
    fine = days.where("r_next is not null").select(*key, F.greatest("calm", "crisis").alias("conf"), F.when(F.col("calm") >= F.col("crisis"), F.col("r_next") > 0).otherwise(F.col("r_next") < 0).cast("double").alias("right"))
    return inference.isotonic_gates(fine, *key).withColumn("tau", F.coalesce("tau", F.lit(0.5)))
