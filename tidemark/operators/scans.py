"""Recursions over one long series in blocks, so that no task holds a series.

The volatility is a chain of affine maps of (variance, squared shock), the regime filter a chain of K x K products; chains of
either kind compose. Rows are dealt by ranges of (ticker, date), so a long series lies in many partitions. The first pass
gives each row its map from the state in which its block begins; the last row of a block has the block's own map. Of those
(a row a block, at most as many a ticker as there are partitions) come the states in which blocks begin, and a join gives
every row its value. The results are those of the grouped maps in `recursions`, up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators.recursions import GARCH, HMM
from tidemark.sources.scratch import written

STATES = ("calm", "stress", "crisis")


def _ranges(rows: DataFrame, step: Callable, columns: str, tasks: int | None) -> DataFrame:
    """rows with `block`, `k` (from 1 in each ticker's part of a block) and what step gives: step gets the next rows of one
    ticker in one block and what it gave last for them (none at the block's start). Written, as both passes need it."""
    names = ["ticker", "date"]
    ranged = (rows.repartitionByRange(tasks, *names) if tasks else rows.repartitionByRange(*names)).sortWithinPartitions(*names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ticker, state, seen = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            cuts = np.flatnonzero(batch["ticker"].ne(batch["ticker"].shift()).to_numpy())
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                part = batch.iloc[a:b]
                if part["ticker"].iloc[0] != ticker:
                    ticker, state, seen = part["ticker"].iloc[0], None, 0
                got, state = step(part, state)
                yield part.assign(block=block, k=np.arange(seen + 1, seen + 1 + len(part)), **got)
                seen += len(part)

    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), "block int", "k long", columns])
    return written(ranged.mapInPandas(run, schema))


def _entries(rows: DataFrame, columns: list[str], follow: Callable[[pd.DataFrame], list], kind: str) -> DataFrame:
    """ticker, block, entry: the state in which each block of a ticker begins; follow gets a row a block, in order."""
    ends = rows.groupBy("ticker", "block").agg(F.max_by(F.struct("k", *columns), "k").alias("end")).select("ticker", "block", "end.*")

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        return pd.DataFrame({"ticker": blocks["ticker"], "block": blocks["block"], "entry": follow(blocks)})

    return ends.groupBy("ticker").applyInPandas(run, f"ticker {rows.schema['ticker'].dataType.simpleString()}, block int, entry {kind}")


def garch(returns: DataFrame, params: dict = GARCH, tasks: int | None = None) -> DataFrame:
    """recursions.garch for series of any length: returns (ticker, date, r; no nulls) with sigma. tasks: partitions (Spark's
    own number if not given). Dates of a ticker are distinct."""
    mu, omega, alpha, beta = (params[n] for n in ("mu", "omega", "alpha", "beta"))

    def step(part: pd.DataFrame, state):
        r = part["r"].to_numpy(dtype=float)
        base, shock, out = *(state or (0.0, None)), np.empty(len(r))
        for i, x in enumerate(r):
            base = omega + beta * base + (0.0 if shock is None else alpha * shock**2)
            out[i] = base
            shock = 100 * x - mu
        return {"base": out, "shock": 100 * r - mu}, (base, shock)

    def follow(blocks: pd.DataFrame) -> list:
        var, shock, out = params["var"], params["shock"], []
        for n, base, last in zip(blocks["k"], blocks["base"], blocks["shock"], strict=True):
            out.append([var, shock])
            var = base + beta**n * var + alpha * beta ** (n - 1) * shock**2
            shock = last
        return out

    rows = _ranges(returns, step, "base double, shock double", tasks)
    entries = _entries(rows, ["base", "shock"], follow, "array<double>")
    var, shock = F.col("entry")[0], F.col("entry")[1]
    now = F.col("base") + F.pow(F.lit(float(beta)), F.col("k")) * var + alpha * F.pow(F.lit(float(beta)), F.col("k") - 1) * shock * shock
    return rows.join(entries, ["ticker", "block"]).select(*returns.columns, (F.sqrt(now * 252) / 100).alias("sigma"))


def _chain(dens: np.ndarray, move: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products diag(b1) T diag(b2) T ... diag(bk) of likelihoods and transitions, each row of a product scaled to sum 1, the logs
    of the scales against each other, and the last product's logs. dens and move are logs; what is impossible stays so."""
    k = dens.shape[1]
    products, logs = np.empty((len(dens), k, k)), np.empty((len(dens), k))
    for t, d in enumerate(dens):
        state = np.where(np.eye(k) > 0, d, -np.inf) if state is None else kernels._logsum(state[:, :, None] + move, 1) + d
        state = state - (state.max() if np.isfinite(state.max()) else 0.0)
        logs[t] = kernels._logsum(state, 1)
        fine = np.isfinite(logs[t])[:, None]
        products[t] = np.exp(np.where(fine, state - np.where(fine, logs[t][:, None], 0.0), -np.inf))
    return products, logs, state


def regime_filter(inputs: DataFrame, model: dict = HMM, tasks: int | None = None) -> DataFrame:
    """recursions.regime_filter for series of any length: inputs (ticker, date, r, rv) with calm, stress and crisis."""
    start, trans = np.asarray(model["start"], dtype=float), np.asarray(model["trans"], dtype=float)
    k = len(start)

    def step(part: pd.DataFrame, state):
        x = (part[["r", "rv"]].to_numpy(dtype=float) - model["centre"]) / model["spread"]
        dens = kernels.log_gauss(x, model["means"], model["covs"])
        with np.errstate(divide="ignore"):
            products, logs, last = _chain(dens - dens.max(axis=1, keepdims=True), np.log(trans), state)
        return {"product": list(products.reshape(len(part), k * k)), "logs": list(logs)}, last

    def follow(blocks: pd.DataFrame) -> list:
        out, likely = [], start
        for product, logs in zip(blocks["product"], blocks["logs"], strict=True):
            out.append(likely)
            with np.errstate(divide="ignore"):
                w = np.log(likely) + np.asarray(logs)
            got = np.exp(w - w.max()) @ np.asarray(product).reshape(k, k)
            likely = got / got.sum() @ trans
        return [v.tolist() for v in out]

    rows = _ranges(inputs, step, "product array<double>, logs array<double>", tasks)
    entries = _entries(rows, ["product", "logs"], follow, "array<double>")
    weights = F.zip_with("entry", "logs", lambda e, s: F.when(e > 0, F.log(e) + s))
    joined = rows.join(entries, ["ticker", "block"]).withColumn("w", weights)
    joined = joined.withColumn("w", F.transform("w", lambda w: F.coalesce(F.exp(w - F.array_max("w")), F.lit(0.0))))
    got = [sum((F.get("w", F.lit(i)) * F.get("product", F.lit(i * k + j)) for i in range(k)), F.lit(0.0)) for j in range(k)]
    total = sum(got, F.lit(0.0))
    return joined.select(*inputs.columns, *[(g / total).alias(n) for g, n in zip(got, STATES, strict=True)])


def numbered(df: DataFrame, *order: str, tasks: int | None = None) -> DataFrame:
    """df with `at`, the row's number (from 0) in the order of some columns, as one stacked series: numbers within ranges, then a
    range's first number (a row a partition)."""
    ranged = (df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield batch.assign(part=part, at=np.arange(seen, seen + len(batch)))
            seen += len(batch)

    rows = written(ranged.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), "part int", "at long"])))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    firsts = np.cumsum([0, *[r["n"] for r in sizes]])
    before = df.sparkSession.createDataFrame([(r["part"], int(f)) for r, f in zip(sizes, firsts, strict=False)], "part int, before long")
    return rows.join(F.broadcast(before), "part").select(*df.columns, (F.col("at") + F.col("before")).alias("at"))
