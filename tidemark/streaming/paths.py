"""The recursions over streams: one state a ticker, the same numbers as in batch, whatever the micro-batches are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import kernels
from tidemark.operators.recursions import GARCH


def garch(returns: DataFrame, params: dict = GARCH) -> DataFrame:
    """returns (ticker, date, r) with sigma; a row older than the last one of its ticker comes out late, with null sigma."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        var, shock, last = state.get if state.exists else (params["var"], params["shock"], "")
        rows = pd.concat(list(batches)).sort_values("date", kind="stable")
        text = rows["date"].astype(str)
        fresh = (text > last).to_numpy()
        r = rows["r"].to_numpy()[fresh]
        path = kernels.garch_path(r, params["mu"], params["omega"], params["alpha"], params["beta"], var, shock)
        sigma = np.full(len(rows), None, dtype=object)
        sigma[fresh] = path
        if len(r):
            state.update(((path[-1] * 100) ** 2 / 252, 100 * float(r[-1]) - params["mu"], text.max()))
        yield pd.DataFrame({"ticker": rows["ticker"], "date": rows["date"], "sigma": sigma, "late": ~fresh})

    return returns.select("ticker", "date", "r").groupBy("ticker").applyInPandasWithState(
        step, "ticker string, date date, sigma double, late boolean", "var double, shock double, last string", "append", GroupStateTimeout.NoTimeout
    )


def windowed(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window; rows later than the watermark are dropped by Spark."""
    from pyspark.sql import functions as F

    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
