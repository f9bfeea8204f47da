"""The bar operators on small frames."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import indicators, patterns, portfolio, quality, rules, waves
from quantloom.sources import files


def bars_of(spark, closes, symbol="A", start=dt.date(2024, 1, 1), **more):
    rows, day = [], start
    for i, c in enumerate(closes):
        while day.weekday() > 4:
            day += dt.timedelta(1)
        rows.append((symbol, day, float(c), float(c) * 1.01, float(c) * 0.99, float(c), float(more.get("volume", [100] * len(closes))[i]), float(c) * 100, 2.0))
        day += dt.timedelta(1)
    return spark.createDataFrame(rows, "symbol string, dt date, open double, high double, low double, close double, volume double, amount double, turn double")


def frame(df):
    return df.toPandas().sort_values(["symbol", "dt"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def walk():
    return np.round(50 + np.cumsum(np.random.default_rng(4).normal(0, 1, 320)), 2)


def test_indicator_chain_equals_pandas(spark, walk):
    got = frame(indicators.macd(indicators.enrich(bars_of(spark, walk))))
    close = pd.Series(walk)
    for n in (5, 20, 250):
        np.testing.assert_allclose(got[f"ma{n}"].astype(float), close.rolling(n).mean(), rtol=1e-12)
    line = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got["macd"], line, atol=1e-12)
    np.testing.assert_allclose(got["macd_hist"], line - line.ewm(span=9, adjust=False).mean(), atol=1e-12)
    change = close.diff()
    gain, loss = change.where(change > 0, 0).rolling(14).mean(), (-change.where(change < 0, 0)).rolling(14).mean()
    np.testing.assert_allclose(got["rsi"].astype(float), 100 - 100 / (1 + gain / loss), rtol=1e-9)
    np.testing.assert_allclose(got["volatility"].astype(float), close.rolling(20).std() / close.rolling(20).mean() * 100, rtol=1e-9)


def test_poc_equals_histogram(spark, walk):
    volume = np.random.default_rng(1).integers(1, 50, len(walk))
    got = frame(indicators.poc(bars_of(spark, walk, volume=volume), n=30))
    for k, value in enumerate(got["poc"]):
        end = 30 + k
        p, v = walk[end - 30 : end], volume[end - 30 : end]
        hist, edges = np.histogram(p, bins=np.linspace(p.min(), p.max(), 50), weights=v)
        at = int(np.argmax(hist))
        assert value == pytest.approx((edges[at] + edges[at + 1]) / 2, abs=(edges[1] - edges[0]) * 1.01)


def test_gap_fill(spark):
    values = [None, 1, None, None, 2, None, None, None, None, None, None, 3, None]
    rows = spark.createDataFrame([("A", dt.date(2024, 1, i + 1), None if v is None else float(v)) for i, v in enumerate(values)], "symbol string, dt date, turn double")
    got = frame(indicators.fill_gaps(rows))["turn_filled"].tolist()
    assert [None if pd.isna(x) else x for x in got] == [None, 1, 1, 1, 2, None, None, None, None, None, None, 3, 3]


def test_upsert_keeps_old_where_new_is_unknown(spark):
    old = spark.createDataFrame([("A", 1, 5.0, 1.0), ("B", 1, 6.0, 2.0)], "symbol string, dt int, close double, turn double")
    new = spark.createDataFrame([("A", 1, 7.0, None), ("C", 1, 8.0, 3.0)], "symbol string, dt int, close double, turn double")
    got = sorted(map(tuple, quality.upsert(old, new, ["symbol", "dt"], ["turn"]).select("symbol", "close", "turn").collect()))
    assert got == [("A", 7.0, 1.0), ("B", 6.0, 2.0), ("C", 8.0, 3.0)]


def test_as_of(spark):
    rows = spark.createDataFrame([("A", d, None) for d in (1, 2, 3, 5)], "symbol string, dt int, v double")
    marks = spark.createDataFrame([("A", 2, 20.0), ("A", 4, 40.0), ("B", 1, 9.0)], "symbol string, as_of int, v double")
    assert {r.dt: r.v for r in quality.as_of(rows, marks, "v").collect()} == {1: None, 2: 20.0, 3: 20.0, 5: 40.0}


def test_symbols(spark):
    from pyspark.sql import functions as F

    names = ["600519", "sh.600519", "sz000001", "830001", "400001", "300750.SZ", "x", None, "920001"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(quality.normalize_symbol(F.col("n")).alias("s")).collect()]
    assert got == ["600519.SH", "600519.SH", "000001.SZ", "830001.BJ", None, "300750.SZ", None, None, "920001.BJ"]


def test_resample_keeps_short_period_only_at_the_end(spark):
    got = frame(quality.resample(bars_of(spark, range(10, 26), start=dt.date(2024, 1, 4)), "week"))
    assert [str(d) for d in got["dt"]] == ["2024-01-12", "2024-01-19", "2024-01-26"] and got["n_bars"].tolist() == [5, 5, 4]


def test_yearline_filter(spark):
    up = frame(rules.yearline_filter(indicators.ma_arrangement(indicators.moving_averages(bars_of(spark, np.linspace(10, 40, 300))))))
    assert up["yearline_pass"].iloc[-1] and not up["yearline_pass"].iloc[200]
    down = frame(rules.yearline_filter(indicators.ma_arrangement(indicators.moving_averages(bars_of(spark, np.linspace(40, 10, 300))))))
    assert not down["yearline_pass"].any()


def test_patterns(spark):
    o = [(10, 9.0), (8.9, 10.2), (10.2, 11), (10.8, 12), (11.5, 13)]
    rows = [("A", dt.date(2024, 1, i + 1), float(a), max(a, b) + 0.1, min(a, b) - 0.1, float(b), 100.0) for i, (a, b) in enumerate(o)]
    got = frame(patterns.candle_flags(spark.createDataFrame(rows, "symbol string, dt date, open double, high double, low double, close double, volume double")))
    assert got["kanzhangtunmo"].tolist() == [False, True, False, False, False]
    assert got["hongsanbing"].tolist() == [False, False, False, True, True]


def test_waves(spark):
    first, second, third = np.linspace(20, 30, 15), np.linspace(29.5, 25, 12), np.linspace(26, 30.5, 6)
    closes = [*np.linspace(24, 20, 30), *first, *second, *third]
    volume = [100] * 30 + [120] * 15 + [60] * 12 + [150] * 6
    got = waves.wave_structure(bars_of(spark, closes, volume=volume)).collect()[0]
    assert got.phase == "third wave" and got.wave1_ok and got.wave2_ok and got.shrinks and got.expands
    assert waves.wave_structure(bars_of(spark, closes[:40])).count() == 0


def test_portfolio(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    series = {"A": x, "B": x * 2, "C": rng.normal(size=60), "D": np.zeros(60)}
    rows = spark.createDataFrame([(s, i, float(v)) for s, vs in series.items() for i, v in enumerate(vs)], "symbol string, dt int, ret double")
    got = {(r.a, r.b): r for r in portfolio.correlations(rows).collect()}
    assert got["A", "B"].rho == 1.0 and got["A", "D"].assumed and got["A", "D"].rho == 0
    assert got["A", "C"].rho == pytest.approx(np.corrcoef(x, series["C"])[0, 1], abs=1e-4)
    risks = spark.createDataFrame([("A", 300.0), ("B", 400.0)], "symbol string, risk double")
    total = portfolio.portfolio_risk(risks, portfolio.correlations(rows)).first()
    assert total.risk == pytest.approx(700.0) and total.ratio == pytest.approx(1.0)


def test_files(spark, tmp_path):
    record = np.zeros(2, dtype=files.DAY_RECORD)
    record["day"], record["close"], record["volume"] = [20240102, 19800101], [1050, 1], [200, 1]
    (tmp_path / "sh600519.day").write_bytes(record.tobytes() + b"tail")
    got = files.day_files(spark, str(tmp_path)).collect()
    assert [(r.symbol, str(r.dt), r.close, r.volume) for r in got] == [("600519.SH", "2024-01-02", 10.5, 2.0)]
    (tmp_path / "list.blk").write_text("1600519\n0000001\n600519\n\njunk\n")
    assert [r.symbol for r in files.symbol_list(spark, str(tmp_path / "list.blk")).collect()] == ["600519.SH", "000001.SZ"]
