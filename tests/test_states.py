"""Regime filter and change points over streams against the batch."""

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import recursions
from tidemark.streaming import states

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def store(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def rows(n=40, seed=0):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"ticker": np.repeat(["a", "b"], n), "ts": np.tile(pd.date_range("2001-01-01", periods=n), 2), "r": rng.normal(size=2 * n) * 0.01})
    return x.assign(rv=rng.uniform(5, 30, 2 * n), size=np.round(rng.uniform(-1, 1, 2 * n), 2))


def stream(spark, tmp_path, batches, recursion, **options):
    """The stream's output over files taken one a micro-batch, with a last file that moves the watermark past all rows."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ticker string, ts timestamp, r double, rv double, size double"
    (tmp_path / "in").mkdir()
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"w{i}"))
        next((tmp_path / f"w{i}").glob("part-*")).rename(tmp_path / "in" / f"{i:03}.parquet")
        got = states.followed(spark.readStream.schema(schema).parquet(source), recursion, **options)
        got.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()
    out = spark.read.parquet(sink).toPandas()
    return out[out["ticker"] != "z"].sort_values(["ticker", "ts"]).reset_index(drop=True)


def end(x, days=60):
    return x.iloc[:1].assign(ticker="z", ts=x["ts"].max() + pd.Timedelta(days=days))


def batch(spark, x, kind):
    df = spark.createDataFrame(x.assign(date=x["ts"].dt.date)).drop("ts")
    got = recursions.regime_filter(df.select("ticker", "date", "r", "rv")) if kind == "regime" else recursions.change_points(df.select("ticker", "date", "size"), "size")
    return got.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)


@pytest.mark.parametrize(("kind", "cut"), [("regime", "days"), ("regime", "mixed"), ("points", "one"), ("points", "mixed")])
def test_stream_equals_batch(store, tmp_path, kind, cut):
    x = rows()
    recursion = states.RegimeFilter() if kind == "regime" else states.ChangePoints("size")
    order = np.random.default_rng(1).permutation(len(x)) if cut == "mixed" else np.argsort(x["ts"], kind="stable")
    parts = {"one": 1, "days": 4, "mixed": 3}[cut]
    batches = [x.iloc[p] for p in np.array_split(order, parts)]
    got = stream(store, tmp_path, [*batches, end(x, 200)], recursion, delay="100 days")
    want = batch(store, x, kind)
    assert len(got) == len(want) and not got["late"].any()
    for c in recursion.outputs:
        assert np.abs(got[c].astype(float) - want[c]).max() < 1e-9


def test_late_rows_and_forgotten_state(store, tmp_path):
    x = rows(30)
    first, missed = x[x["ts"] != x["ts"].iloc[5]], x[x["ts"] == x["ts"].iloc[5]]
    again = x.iloc[[40]].assign(ts=pd.Timestamp("2002-06-01"))
    got = stream(store, tmp_path, [first, end(x, 5), missed, again, end(again, 40)], states.RegimeFilter(), delay="3 days", forget=timedelta(days=100))
    on_time = got[~got["late"]]
    want = batch(store, first, "regime")
    assert len(on_time) == len(want) + 1
    assert np.abs(on_time.iloc[: len(want) // 2]["calm"].to_numpy(dtype=float) - want["calm"].iloc[: len(want) // 2].to_numpy()).max() < 1e-9
    assert got[got["late"]]["calm"].isna().all()
    fresh = on_time[on_time["ts"] == pd.Timestamp("2002-06-01")]["calm"].astype(float).item()
    alone = batch(store, again, "regime")["calm"].item()
    assert abs(fresh - alone) < 1e-9
