"""The regime filter and the change points over streams: an array of numbers a ticker is the state, whatever the micro-batches are.

Rows wait until the watermark has passed them and are then worked off in date order, so a stream gives what a batch gives,
in whatever order rows come within the watermark's delay. A row that comes after one of its ticker with the same or a later
date has been worked off is late: it comes out at once, with late = true and no numbers. A ticker's state goes when
the watermark has moved `forget` past its last row; what comes later starts afresh. The session needs the RocksDB state
store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import kernels
from tidemark.operators.recursions import HAZARD, HMM


class RegimeFilter:
    """P(state | rows so far). The state is the K log probabilities."""

    inputs, outputs = ["r", "rv"], ["calm", "stress", "crisis"]

    def __init__(self, model: dict = HMM):
        self.model = model

    def step(self, state: list[float] | None, values: np.ndarray) -> tuple[list[float], list[float]]:
        m = self.model
        dens = kernels.log_gauss((values[None] - m["centre"]) / m["spread"], m["means"], m["covs"])[0]
        with np.errstate(divide="ignore"):
            before = np.log(m["start"]) if state is None else kernels._logsum(np.array(state)[:, None] + np.log(m["trans"]), 0)
        now = dens + before
        now = now - kernels._logsum(now, 0)
        return now.tolist(), np.exp(now).tolist()


class ChangePoints:
    """Most probable run length and P(run length <= window). The state is one array: rows, share lost, and of each run held its
    length, log share, mean and scale. drop bounds it to the length of a regime (kernels.RunLengths); 0 keeps every run."""

    outputs = ["map_run_length", "cp_prob"]

    def __init__(self, column: str = "size", hazard: float = HAZARD, window: int = 5, drop: float = 1e-20):
        self.inputs, self.hazard, self.window, self.drop = [column], hazard, window, drop

    def step(self, state: list[float] | None, values: np.ndarray) -> tuple[list[float], list[float]]:
        runs = kernels.RunLengths(self.hazard, self.window, self.drop)
        if state is not None:
            runs.rows, runs.lost = int(state[0]), state[1]
            length, runs.log_r, runs.mean, runs.beta = np.array(state[2:]).reshape(4, -1)
            runs.length = length.astype(np.int64)
        got = runs.step(float(values[0]))
        return [float(runs.rows), runs.lost, *np.concatenate([runs.length, runs.log_r, runs.mean, runs.beta]).tolist()], [float(g) for g in got]


class _Ordered(StatefulProcessor):
    def __init__(self, recursion: RegimeFilter | ChangePoints, forget: timedelta):
        self.recursion, self.forget = recursion, int(forget.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, x array<double>")
        self.state = handle.getValueState("state", "ms long, x array<double>")

    def _out(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame({"ticker": pd.Series([key[0]] * len(rows), dtype=object), "ts": pd.to_datetime([r[0] for r in rows], unit="ms", utc=True), "late": [r[1] is None for r in rows]})
        for i, n in enumerate(self.recursion.outputs):
            out[n] = pd.Series([None if r[1] is None else r[1][i] for r in rows], dtype=object)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else None
        late, fresh = [], []
        for batch in rows:
            times = batch["ts"].dt.tz_localize("UTC") if batch["ts"].dt.tz is None else batch["ts"].dt.tz_convert("UTC")
            for ms, x in zip((times.astype("int64") // _unit(times)).tolist(), batch[self.recursion.inputs].to_numpy(dtype=float).tolist(), strict=True):
                (late if last is not None and ms <= last else fresh).append((ms, x))
        if fresh:
            self.waiting.appendList(fresh)
            for ms in {ms for ms, _ in fresh}:
                self.handle.registerTimer(ms)
        yield self._out(key, [(ms, None) for ms, _ in late])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        state = self.state.get() if self.state.exists() else None
        if state is not None and until >= state[0] + self.forget:
            for other in self.handle.listTimers():
                if other == state[0] + self.forget:
                    self.handle.deleteTimer(other)
            self.state.clear()
            state = None
        rows = sorted((int(ms), list(x)) for ms, x in self.waiting.get())
        due = [r for r in rows if r[0] <= until]
        out, now = [], None if state is None else list(state[1])
        for ms, x in due:
            now, got = self.recursion.step(now, np.array(x, dtype=float))
            out.append((ms, got))
        if due:
            rest = rows[len(due) :]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            self.state.update((due[-1][0], now))
            if state is not None:
                self.handle.deleteTimer(state[0] + self.forget)
            self.handle.registerTimer(due[-1][0] + self.forget)
        yield self._out(key, out)

    def close(self) -> None:
        pass


def _unit(times: pd.Series) -> int:
    """Of the series' own unit in a millisecond."""
    return {"ns": 1_000_000, "us": 1000, "ms": 1}[times.dt.unit]


def followed(rows: DataFrame, recursion: RegimeFilter | ChangePoints, delay: str = "2 days", forget: timedelta = timedelta(days=365)) -> DataFrame:
    """ticker, ts, late and the recursion's outputs of a stream (ticker, ts timestamp, inputs; no nulls), one row of a ticker a time."""
    numbers = ", ".join(f"{n} double" for n in recursion.outputs)
    return rows.select("ticker", "ts", *recursion.inputs).withWatermark("ts", delay).groupBy("ticker").transformWithStateInPandas(
        statefulProcessor=_Ordered(recursion, forget), outputStructType=f"ticker string, ts timestamp, late boolean, {numbers}", outputMode="Append", timeMode="EventTime"
    )
