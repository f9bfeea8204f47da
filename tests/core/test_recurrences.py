"""Exponential means as a scan, and correlations by blocks, against pandas."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import indicators, portfolio


def by_pandas(close: pd.Series) -> pd.DataFrame:
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    line = ema(close, 12) - ema(close, 26)
    return pd.DataFrame({"macd": line, "macd_signal": ema(line, 9), "macd_hist": line - ema(line, 9), "macd_area": line.cumsum()})


def test_macd_of_several_symbols(spark):
    """Runs of one bar, of a year and of many years; flat prices give zeros, not what rounding leaves."""
    rng = random.Random(1)
    days = [dt.date(2019, 12, 20) + dt.timedelta(i) for i in range(900)]
    series = {"A": days, "B": days[::97], "C": days[:1], "D": [*days[:30], *days[850:]], "FLAT": days[:500]}
    rows = [(s, d, 37.1 if s == "FLAT" else rng.uniform(5, 500), s) for s, v in series.items() for d in v]
    found = indicators.macd(spark.createDataFrame(rows, "symbol string, dt date, close double, kept string").repartition(5)).toPandas()
    assert list(found.columns) == ["symbol", "dt", "close", "kept", "macd", "macd_signal", "macd_hist", "macd_area"]
    for s, v in series.items():
        got = found[found["symbol"] == s].sort_values("dt").reset_index(drop=True)
        want = by_pandas(got["close"])
        assert len(got) == len(v) and (got["kept"] == s).all()
        assert np.abs(got[want.columns] - want).to_numpy().max() < 1e-8
    assert (found[found["symbol"] == "FLAT"]["macd"] == 0).mean() > 0.7


def test_macd_passes_over_bars_without_close(spark):
    closes = [None, 10.0, None, 12.0, 11.0, None]
    rows = [("A", dt.date(2023, 12, 28) + dt.timedelta(i), c) for i, c in enumerate(closes)] + [("B", dt.date(2024, 1, 1), None)]
    found = indicators.macd(spark.createDataFrame(rows, "symbol string, dt date, close double")).orderBy("symbol", "dt").collect()
    want = by_pandas(pd.Series([10.0, 12.0, 11.0]))
    at = [None, 0, 0, 1, 2, 2]
    for r, i in zip(found, [*at, None], strict=True):
        for c in ("macd", "macd_signal", "macd_area"):
            assert r[c] is None if i is None else r[c] == pytest.approx(want[c][i], abs=1e-12)


def test_macd_of_one_long_symbol_in_many_tasks(spark):
    """A million bars of one symbol, by the minute: no task has them all."""
    n = 1_000_000
    at = F.timestamp_seconds(F.col("id") * 60 + 1_600_000_000)
    close = 100 + 20 * F.sin(F.col("id") / 3000) + F.pmod(F.col("id") * 7919, F.lit(101)) / 50
    bars = spark.range(n).select(F.lit("A").alias("symbol"), at.alias("dt"), close.alias("close"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
        found = indicators.macd(bars).withColumn("task", F.spark_partition_id()).select("dt", "close", "macd", "macd_signal", "macd_area", "task").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")
    assert found.groupby("task").size().max() < n / 2
    found = found.sort_values("dt").reset_index(drop=True)
    want = by_pandas(found["close"])
    assert np.abs(found["macd"] - want["macd"]).max() < 1e-9 and np.abs(found["macd_signal"] - want["macd_signal"]).max() < 1e-9
    assert np.abs(found["macd_area"] - want["macd_area"]).max() < 1e-5


def test_correlations_by_blocks(spark):
    """All pairs, whatever the blocks: common days, too few of them, none, and series that do not move on the common days."""
    rng = np.random.default_rng(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(80)]
    base = rng.normal(0, 0.01, 80)
    series = {f"S{i}": {d: float(base[k] * (i % 3) + rng.normal(0, 0.01)) for k, d in enumerate(days) if (k + i) % 5} for i in range(12)}
    series |= {"EARLY": {d: 0.01 * k for k, d in enumerate(days[:30])}, "LATE": {d: 0.02 * k for k, d in enumerate(days[30:])}, "FLAT": dict.fromkeys(days, 0.003)}
    series["HALF"] = {d: 0.5 if k < 40 else float(base[k]) for k, d in enumerate(days)}
    series["EDGE"] = {d: float(base[k]) for k, d in enumerate(days[:40])}
    rows = [(s, d, r) for s, v in series.items() for d, r in v.items()] + [("S1", dt.date(2025, 1, 1), None)]
    frame = spark.createDataFrame(rows, "symbol string, dt date, ret double")
    want = {}
    for a, b in itertools.combinations(sorted(series), 2):
        both = sorted(series[a].keys() & series[b].keys())
        x, y = np.array([series[a][d] for d in both]), np.array([series[b][d] for d in both])
        moves = len(both) >= 20 and np.ptp(x) > 0 and np.ptp(y) > 0
        want[a, b] = (len(both), round(float(np.corrcoef(x, y)[0, 1]), 4) if moves else 0.0, not moves)
    for cells in (2**20, 500, 1):
        got = {(r.a, r.b): (r.n_common, r.rho, r.assumed) for r in portfolio.correlations(frame, block_cells=cells).collect()}
        assert got.keys() == want.keys()
        for k, (n, rho, assumed) in want.items():
            assert got[k][0] == n and got[k][2] == assumed and got[k][1] == pytest.approx(rho, abs=1.01e-4), k
    assert want["EARLY", "LATE"] == (0, 0.0, True) and want["EDGE", "HALF"] == (40, 0.0, True)
    assert portfolio.correlations(frame.limit(0)).collect() == []
