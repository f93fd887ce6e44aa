"""Expressions over a ticker's rows in date order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by() -> WindowSpec:
    return W.partitionBy("ticker").orderBy("date")


def prefix() -> WindowSpec:
    return by().rowsBetween(W.unboundedPreceding, 0)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with ties moved up a little so that engines agree on them, and never minus zero."""
    return F.round(c + 1e-9, digits) + F.lit(0.0)


def rolling(agg, x: Column, rows: int) -> Column:
    """agg over the last rows; null until there are as many values."""
    frame = by().rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) >= rows, agg(x).over(frame))


def log_return(price: Column) -> Column:
    return F.log(price / F.lag(price).over(by()))


def momentum(price: Column, rows: int) -> Column:
    return price / F.lag(price, rows).over(by()) - 1


def filled_forward(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(prefix())


def average_rank(x: Column, *partition: str) -> Column:
    """Rank from 1; equal values share the mean of their ranks."""
    return F.rank().over(W.partitionBy(*partition).orderBy(x)) + (F.count("*").over(W.partitionBy(*partition, x)) - 1) / F.lit(2.0)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by keys over twice the cores at hand: for groups of few bytes and long work, which a runtime that goes by bytes
    would put into one task."""
    many = max(2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(many, *keys)
