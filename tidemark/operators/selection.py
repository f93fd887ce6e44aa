"""Exact percentiles of any number of values by counting: no buffer holds a key's values.

A double's bits, in order, are found sixteen at a time. A pass counts, of the values that share the bits found so far with a
wanted rank, the next sixteen bits; the bucket that the rank falls into gives them. After four passes the value is
known. Counts are made before the shuffle, so a key with most of the rows is no hot spot, and a pass holds at most
65,536 counts a wanted rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tidemark.sources.scratch import written

BITS, PASSES = 16, 4
#: Wanted ranks that are sent to all tasks; beyond it, the passes join by a shuffle.
FEW = 200_000


@F.pandas_udf(LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """A double as a number whose unsigned order is the double's (both zeros are one, NaN comes last)."""
    v = x.to_numpy(dtype=np.float64) + 0.0
    bits = np.where(np.isnan(v), np.float64("nan"), v).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))))


@F.pandas_udf(DoubleType())
def from_bits(code: pd.Series) -> pd.Series:
    bits = code.to_numpy(dtype=np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(-(2**63)), ~bits).view(np.float64))


def _next_bits(rows: DataFrame, wanted: DataFrame, keys: list[str], step: int) -> DataFrame:
    """wanted (keys, rank, left, prefix) with sixteen more bits of prefix; left: the rank among the values that share them."""
    shift = 64 - BITS * step
    prefix = F.shiftrightunsigned("code", shift) if step else F.lit(0).cast("long")
    digit = F.shiftrightunsigned("code", shift - BITS).bitwiseAND(F.lit(2**BITS - 1))
    groups = wanted.select(*keys, "prefix").distinct()
    side = F.broadcast(groups) if groups.limit(FEW + 1).count() <= FEW else groups
    counts = rows.select(*keys, prefix.alias("prefix"), digit.alias("digit")).join(side, [*keys, "prefix"]).groupBy(*keys, "prefix", "digit").agg(F.count("*").alias("n"))
    order = W.partitionBy(*keys, "prefix").orderBy("digit").rowsBetween(W.unboundedPreceding, 0)  # 65,536 rows at most
    counts = counts.withColumn("until", F.sum("n").over(order))
    found = wanted.join(counts, [*keys, "prefix"]).where((F.col("left") < F.col("until")) & (F.col("left") >= F.col("until") - F.col("n")))
    return written(found.select(*keys, "rank", (F.col("left") - F.col("until") + F.col("n")).alias("left"), (F.shiftleft("prefix", BITS) + F.col("digit")).alias("prefix")))


def percentiles(df: DataFrame, column: str | Column, shares: list[float] | tuple[float, ...], *keys: str) -> DataFrame:
    """keys, n, share, value: linear percentiles of a column in each group of keys, as percentile() gives; nulls are left out. A
    group without a value has no row, nor has a null key."""
    x = F.col(column) if isinstance(column, str) else column
    names = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    rows = written(base.select(*names, x.cast("double").alias("x")).where("x is not null").select(*names, ordered_bits("x").alias("code")))
    sizes = rows.groupBy(*names).agg(F.count("*").alias("n"))
    points = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at")) for s in shares])).alias("p")
    places = written(sizes.select(*names, "n", points).select(*names, "n", "p.share", "p.at", F.floor("p.at").alias("low"), F.ceil("p.at").alias("high")))
    ranks = places.select(*names, F.explode(F.array("low", "high")).alias("rank")).distinct()
    wanted = ranks.select(*names, "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for step in range(PASSES):
        wanted = _next_bits(rows, wanted, names, step)
    values = wanted.select(*names, "rank", from_bits("prefix").alias("value"))
    side = lambda c: values.select(*names, F.col("rank").alias(c), F.col("value").alias(f"{c}_value"))
    both = places.join(side("low"), [*names, "low"]).join(side("high"), [*names, "high"])
    between = (F.col("high") - F.col("at")) * F.col("low_value") + (F.col("at") - F.col("low")) * F.col("high_value")
    value = F.when((F.col("low") == F.col("high")) | (F.col("low_value") == F.col("high_value")), F.col("low_value")).otherwise(between)
    return both.select(*keys, "n", "share", value.alias("value"))
