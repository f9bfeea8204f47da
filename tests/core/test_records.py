"""Records around the bars, gaps and sector scores against results worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import patterns, records, relations

DAY = dt.date(2024, 1, 1)


def bars(spark, closes, symbol="A", opens=None, lows=None, amounts=None):
    rows = []
    for i, c in enumerate(closes):
        o = (opens or {}).get(i, c)
        rows.append((symbol, DAY + dt.timedelta(days=i), float(o), max(o, c) + 0.1, (lows or {}).get(i, min(o, c) - 0.1), float(c), 100.0, float((amounts or {}).get(i, 10))))
    return spark.createDataFrame(rows, "symbol string, dt date, open double, high double, low double, close double, volume double, amount double")


def gap(spark, *args, **kwargs):
    return patterns.latest_gap(bars(spark, *args, **kwargs)).collect()[0]


def test_gap_classes(spark):
    flat = [10.0] * 45
    r = gap(spark, flat + [10.6, 10.7, 10.8, 10.9], opens={45: 10.5}, lows={45: 10.4})
    assert (r.gap_up, r.gap_type, r.unfilled_days, r.confirmed, r.gap_pct) == (True, "breakout", 4, True, 3.96)
    rise = [10.0] * 25 + [10 + 0.3 * i for i in range(1, 21)]
    r = gap(spark, rise + [17.5, 16.0], opens={45: 17.0}, lows={46: 15.0})
    assert (r.gap_type, r.unfilled_days, r.confirmed, r.above_ma20) == ("exhaustion", 1, False, True)
    r = gap(spark, rise + [16.5, 16.6], opens={45: 16.4})
    assert r.gap_type == "continuation" and r.unfilled_days == 2
    # the newest gap is below 1 %, so the older, larger one does not count
    r = gap(spark, flat + [10.6, 10.7, 10.8, 10.9], opens={45: 10.5, 48: 10.92})
    assert not r.gap_up and r.gap_type is None and r.unfilled_days == 0 and 0 < r.gap_pct < 1
    assert not gap(spark, [10.0, 10.0]).gap_up and not gap(spark, flat).gap_up


def test_sector_scores(spark):
    flat = [10.0] * 30
    made = bars(spark, flat, "flat")
    for name, closes, amounts in (("up", flat + [11.0], None), ("lively", flat + [11.0], {30: 100}), ("down", flat + [9.0], None), ("weaker", flat + [9.6], None), ("short", [10.0] * 4, None)):
        made = made.unionByName(bars(spark, closes, name, amounts=amounts))
    scores = {r.symbol: r.score for r in relations.sector_scores(made).collect()}
    assert scores == {"flat": 0, "up": 2, "lively": 3, "down": -2, "weaker": -1}
    got = relations.sector_census(relations.sector_scores(made)).collect()[0]
    assert (got.sectors, got.strong, got.weak, got.neutral, got.trend, got.strength) == (5, 2, 1, 2, "swing", 30)
    assert [r.symbol for r in relations.strongest_sectors(relations.sector_scores(made)).collect()] == ["lively", "up"]


def test_checksum_sees_prices_in_the_middle(spark):
    base = [10.0 + i for i in range(9)]
    of = lambda closes: records.checksum(bars(spark, closes)).collect()[0].checksum
    assert of(base) == of(base) != of([*base[:4], 14.5, *base[5:]]) and len(of(base)) == 16
    now, old = records.checksum(bars(spark, base)), records.checksum(bars(spark, [c * 2 for c in base]))
    assert records.changed(now, old).collect()[0].recompute and not records.changed(now, now).collect()[0].recompute


def test_labels_and_unknowns(spark):
    one = spark.createDataFrame([("2024-02-03T10:00:00", " Weekly", None), ("nothing", "hourly", "HFQ")], "s string, f string, a string")
    got = one.select(records.day("s").alias("d"), records.frequency(F.col("f")).alias("f"), records.adjustment(F.col("a")).alias("a")).collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 2, 3), "1w", "none"), (None, None, "hfq")]
    rows = spark.createDataFrame([("A", True, True, None, None), ("B", True, True, False, None), ("C", None, True, False, True), ("D", True, True, True, False)], "symbol string, stock_strict boolean, industry_up boolean, market_up boolean, market_not_high boolean")
    rows = rows.withColumn("is_index", F.lit(None).cast("boolean"))
    assert [r.symbol for r in records.only_market_mismatch(rows).orderBy("symbol").collect()] == ["B", "D"]
    with pytest.raises(ValueError, match="lack close"):
        records.sector_rows(spark.createDataFrame([("A", DAY, 1.0, 1.0, 1.0)], "symbol string, dt date, open double, high double, low double"))
    d = spark.createDataFrame([("top", "top"), ("top", "bottom"), (None, "top"), ("bottom", ""), (None, None)], "d string, w string")
    assert [r[0] for r in d.select(records.divergence_label(F.col("d"), F.col("w"))).collect()] == ["day+week top", "day top / week bottom", "week top", "day bottom", ""]
