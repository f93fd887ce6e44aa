"""Lagged, cost-aware backtest and performance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import by, prefix

YEAR = 252


def run(returns: DataFrame, weights: DataFrame, cost_bps: float = 1.0, lag: int = 1) -> DataFrame:
    """ticker, date, r, w, gross, cost, net, equity over the dates that both have; weights act `lag` rows later."""
    own = F.coalesce("size", F.lit(0.0))
    w = F.coalesce(F.lag(own, lag).over(by()), F.lit(0.0)) if lag else own
    df = returns.select("ticker", "date", "r").join(weights.select("ticker", "date", "size"), ["ticker", "date"]).withColumn("w", w)
    df = df.withColumn("gross", F.col("w") * F.col("r")).withColumn("cost", F.lit(cost_bps / 1e4) * F.abs(F.col("w") - F.coalesce(F.lag("w").over(by()), F.lit(0.0))))
    df = df.withColumn("net", F.col("gross") - F.col("cost"))
    equity = F.when(F.col("net").isNotNull(), F.product(1 + F.col("net")).over(prefix()))
    return df.withColumn("equity", equity).drop("size")


def sharpe(x: Column, rf: float = 0.0) -> Column:
    return F.when((F.count(x) >= 2) & (F.stddev_samp(x) > 0), (F.avg(x) - rf / YEAR) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * YEAR**0.5)


def sortino(x: Column, mar: float = 0.0) -> Column:
    down = F.sqrt(F.avg(F.least(x - mar / YEAR, F.lit(0.0)) ** 2))
    return F.avg(x - mar / YEAR) / F.nullif(down, F.lit(0.0)) * YEAR**0.5


def profit_factor(x: Column) -> Column:
    """Gains over losses; infinite for gains alone, null for neither."""
    gains, losses = F.sum(F.when(x > 0, x).otherwise(0.0)), -F.sum(F.when(x < 0, x).otherwise(0.0))
    return F.when(losses > 0, gains / F.nullif(losses, F.lit(0.0))).when(gains > 0, F.lit(float("inf")))


def with_drawdown(df: DataFrame) -> DataFrame:
    """Adds curve (null returns count as 0), drawdown and turned, what metrics() needs, in the backtest's own partitioning."""
    df = df.withColumn("curve", F.product(1 + F.coalesce("net", F.lit(0.0))).over(prefix()))
    return df.withColumns({"drawdown": F.col("curve") / F.max("curve").over(prefix()) - 1, "turned": F.abs(F.col("w") - F.lag("w").over(by()))})


def metrics(df: DataFrame) -> DataFrame:
    """One row a ticker: the summary of its net returns."""
    net = F.col("net")
    out = with_drawdown(df).groupBy("ticker").agg(
        F.count(net).alias("n"), sharpe(net).alias("sharpe"), sortino(net).alias("sortino"), F.min("drawdown").alias("max_drawdown"),
        F.max_by("curve", "date").alias("final"), profit_factor(net).alias("profit_factor"), F.avg(F.when(net.isNotNull(), (net > 0).cast("double"))).alias("hit_rate"), F.avg("turned").alias("turnover"),
    )
    grown = F.when(F.col("final") > 0, F.col("final"))
    calmar = (F.pow(grown, F.lit(float(YEAR)) / F.col("n")) - 1) / F.nullif(F.abs("max_drawdown"), F.lit(0.0))
    return out.withColumn("calmar", F.when(F.col("n") > 0, calmar))
