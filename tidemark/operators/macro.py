"""Market snapshots: what was known of the index, risk, rates, sectors and a ticker at the close of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.series import by, momentum

MONTH, QUARTER, YEAR = 21, 63, 252


def states(bars: DataFrame) -> DataFrame:
    """ticker, date, close, ret_1d, ret_1m, ret_3m, first (the first close of the row's year), percentile (share of the last 252
    closes that are not above this one). Returns are null with too few rows or from a close that is not positive."""
    p = F.col("close")
    back = lambda n: F.when(F.lag(p, n).over(by()) > 0, momentum(p, n))
    year = F.collect_list(p).over(by().rowsBetween(-(YEAR - 1), 0))  # 252 numbers
    df = bars.select("ticker", "date", "close").withColumns({"ret_1d": back(1), "ret_1m": back(MONTH), "ret_3m": back(QUARTER), "first": F.first("close").over(W.partitionBy("ticker", F.year("date")).orderBy("date")), "h": year})
    return df.withColumn("percentile", F.size(F.filter("h", lambda x: x <= F.col("close"))) / F.size("h")).drop("h")


def as_of(states: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ticker, date) with seen, ret_ytd and the columns of the last state at or before it. One ordered pass over both."""
    columns = [c for c in states.columns if c not in ("ticker", "date")]
    rows = states.select("ticker", "date", F.struct(F.col("date").alias("seen"), *columns).alias("s"), F.lit(False).alias("asked"))
    ask = asked.select("ticker", "date").distinct().select("ticker", "date", F.lit(None).cast(rows.schema["s"].dataType).alias("s"), F.lit(True).alias("asked"))
    last = F.last("s", ignorenulls=True).over(W.partitionBy("ticker").orderBy("date", "asked").rowsBetween(W.unboundedPreceding, 0))
    out = rows.unionByName(ask).withColumn("s", last).where("asked").select("ticker", "date", "s.*")
    ytd = F.when((F.year("seen") == F.year("date")) & (F.col("first") > 0), F.col("close") / F.col("first") - 1)
    return out.withColumn("ret_ytd", ytd)


def snapshots(bars: DataFrame, asked: DataFrame, index: str, risk: str, rate: str, sectors: list[str]) -> DataFrame:
    """ticker, date of asked, index_*, risk_*, rate_*, own_*, and rotation: array of (sector, excess over the index in a month),
    strongest first, sectors without a value left out. Days before the first close of the index, risk or rate give no row."""
    days, known = asked.select("date").distinct(), states(bars)
    wanted = sorted({index, risk, rate, *sectors})
    grid = days.select("date", F.explode(F.array(*map(F.lit, wanted))).alias("ticker"))
    seen = as_of(known.where(F.col("ticker").isin(wanted)), grid)
    of = lambda name, c: F.max(F.when(F.col("ticker") == name, F.col(c)))
    market = seen.groupBy("date").agg(
        *[of(index, c).alias(f"index_{c}") for c in ("close", "ret_1m", "ret_3m", "ret_ytd")],
        *[of(risk, c).alias(f"risk_{c}") for c in ("close", "ret_1d", "percentile")],
        *[of(rate, c).alias(f"rate_{c}") for c in ("close", "ret_1d")],
        F.collect_list(F.when(F.col("ticker").isin(sectors), F.struct("ticker", "ret_1m"))).alias("s"),  # a row a sector
    ).where("index_close is not null and risk_close is not null and rate_close is not null")
    excess = F.transform("s", lambda x: F.struct((-F.round(x["ret_1m"] - F.col("index_ret_1m"), 9)).alias("less"), x["ticker"].alias("sector"), (x["ret_1m"] - F.col("index_ret_1m")).alias("excess")))
    ranked = F.array_sort(F.filter(excess, lambda x: x["excess"].isNotNull()))
    market = market.withColumn("rotation", F.transform(ranked, lambda x: F.struct(x["sector"].alias("sector"), x["excess"].alias("excess")))).drop("s")
    own = as_of(known, asked).select("ticker", "date", *[F.col(c).alias(f"own_{c}") for c in ("close", "ret_1m", "ret_3m", "ret_ytd")])
    return own.join(market, "date")
