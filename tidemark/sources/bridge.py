"""Bars, decisions and regime fixtures derived from the orders table, and the same as SQL.

Bars: one per priority class (ticker) and order date. Decisions: one per bar, some days left out so that calendars have gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Names of the personalities that a decision carries, and words that an order may use.
PERSONAS = ("warren_buffett", "cathie_wood", "stanley_druckenmiller", "michael_burry", "bill_ackman")
WORDS = ("buy", "cover", "sell", "short", "hold", "bullish", "bearish", "other")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("close"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.count("*").alias("volume"), F.sum("o_custkey").alias("ck"), F.sum("o_orderkey").alias("ok"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).select("ticker", "date", "close", "high", "low", "volume")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = ((F.col("ck") % 51) - 25) / F.lit(100.0)
    return _daily(spark, sf_dir).where("ok % 7 <> 0").select(
        "ticker", "date", size.alias("size"), ((F.col("ok") % 101) / F.lit(100.0)).alias("confidence"),
        F.when(size > 0, "long").when(size < 0, "short").otherwise("hold").alias("action"),
    )


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (1 + F.col("ck") % k for k in (7, 5, 3))
    return _daily(spark, sf_dir).select("ticker", "date", (a / (a + b + c)).alias("calm"), (b / (a + b + c)).alias("stress"), (c / (a + b + c)).alias("crisis"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an agent asks for, one row a decision: word, quantity, price and cash."""
    words = F.array(*map(F.lit, WORDS))
    return _daily(spark, sf_dir).where("ok % 7 <> 0").select(
        "ticker", "date", F.element_at(words, (F.col("ok") % len(WORDS) + 1).cast("int")).alias("word"),
        ((F.col("ck") % 41) - 2).alias("quantity"), F.col("close").alias("price"), (F.col("ok") % 9 * F.lit(250_000.0)).alias("cash"),
    )


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions' personalities, as the readers give them: a map by name; one of them is absent on some days."""
    one = lambda i: F.struct(F.element_at(F.array(F.lit("long"), F.lit("short"), F.lit("hold")), ((F.col("ck") + i) % 3 + 1).cast("int")).alias("action"), F.lit(0.0).alias("size"), ((F.col("ok") + 7 * i) % 101 / F.lit(100.0)).alias("confidence"))
    entries = F.array(*[F.struct(F.lit(n).alias("key"), one(i).alias("value"), F.lit(i).alias("i")) for i, n in enumerate(PERSONAS)])
    there = F.filter(entries, lambda e: (F.col("ok") % 11) != e["i"])
    return _daily(spark, sf_dir).where("ok % 7 <> 0").select("ticker", "date", F.map_from_entries(F.transform(there, lambda e: F.struct(e["key"], e["value"]))).alias("personalities"))


SQL = """
daily AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close, max(o_totalprice) AS high,
  min(o_totalprice) AS low, count(*) AS volume, CAST(sum(o_custkey) AS BIGINT) AS ck, CAST(sum(o_orderkey) AS BIGINT) AS ok
  FROM orders GROUP BY 1, 2),
rets AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM daily),
dec AS (SELECT ticker, date, ((ck % 51) - 25) / 100.0::DOUBLE AS size, (ok % 101) / 100.0::DOUBLE AS confidence,
  CASE WHEN ck % 51 > 25 THEN 'long' WHEN ck % 51 < 25 THEN 'short' ELSE 'hold' END AS action FROM daily WHERE ok % 7 <> 0),
reg AS (SELECT ticker, date, (1 + ck % 7) / (3 + ck % 7 + ck % 5 + ck % 3)::DOUBLE AS calm, (1 + ck % 5) / (3 + ck % 7 + ck % 5 + ck % 3)::DOUBLE AS stress,
  (1 + ck % 3) / (3 + ck % 7 + ck % 5 + ck % 3)::DOUBLE AS crisis FROM daily),
bt0 AS (SELECT ticker, date, r, coalesce(lag(coalesce(size, 0)) OVER (PARTITION BY ticker ORDER BY date), 0) AS w FROM rets JOIN dec USING (ticker, date)),
bt AS (SELECT *, w * r AS gross, 0.0001::DOUBLE * abs(w - coalesce(lag(w) OVER (PARTITION BY ticker ORDER BY date), 0)) AS cost,
  w * r - 0.0001::DOUBLE * abs(w - coalesce(lag(w) OVER (PARTITION BY ticker ORDER BY date), 0)) AS net FROM bt0),
lab AS (SELECT ticker, date, r, lead(r) OVER (PARTITION BY ticker ORDER BY date) AS r_next FROM rets),
dl AS (SELECT d.*, l.r, l.r_next, calm, stress, crisis FROM dec d LEFT JOIN lab l USING (ticker, date) LEFT JOIN reg USING (ticker, date))"""
