"""Hand-worked audits, market verdicts and changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quantloom.operators import audits

SCHEMA = "symbol string, dt date, open double, high double, low double, close double, volume double, amount double, turn double"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(i)


def bar(symbol, i, **other):
    made = dict(symbol=symbol, dt=day(i), open=10.0, high=11.0, low=9.0, close=10.0, volume=5.0, amount=50.0, turn=1.0) | other
    return tuple(made.values())


def test_findings(spark):
    rows = [
        bar("A", 0), bar("A", 1, close=None), bar("A", 2, close=0.0), bar("A", 3, high=8.0), bar("A", 3, high=8.0), bar("A", 3), bar("A", 10), bar("A", 18),
        bar("B", 0, open=None, high=None, low=None), bar("B", 8, amount=None), bar("B", 9, amount=0.0, volume=0.0), bar("B", 10, low=9.5, open=9.0),
        bar("C", 18, turn=None), bar("D", 18, turn=0.0), bar("E", 18, turn=None, volume=None), bar("F", 18, turn=-1.0),
    ]
    bars = spark.createDataFrame(rows, SCHEMA)
    # a day three times is one key; a zero close is also below its low; ten days are no gap of A's 3 to 10 (seven), eight are
    got = audits.audit_report(bars).first().asDict()
    assert got == dict(n_rows=16, duplicate_key=1, bad_close=2, invalid_ohlc=4, volume_no_amount=1, long_gap=2, latest_day=day(18), no_turnover=3, no_turnover_ratio=0.6, source_gap_likely=True)
    found = sorted((r.check, r.symbol, (r.dt - day(0)).days, r.value) for r in audits.audit_samples(bars).where("check <> 'bad_close'").collect())
    assert found == [
        ("duplicate_key", "A", 3, None), ("invalid_ohlc", "A", 2, 0.0), ("invalid_ohlc", "A", 3, 10.0), ("invalid_ohlc", "A", 3, 10.0), ("invalid_ohlc", "B", 10, 10.0),
        ("long_gap", "A", 18, 8.0), ("long_gap", "B", 8, 8.0), ("no_turnover", "C", 18, None), ("no_turnover", "D", 18, 0.0), ("no_turnover", "F", 18, -1.0), ("volume_no_amount", "B", 8, 5.0),
    ]
    first = sorted((r.check, r.symbol, (r.dt - day(0)).days) for r in audits.audit_samples(bars, 1).collect())
    assert first == [("bad_close", "A", 1), ("duplicate_key", "A", 3), ("invalid_ohlc", "A", 2), ("long_gap", "A", 18), ("no_turnover", "C", 18), ("volume_no_amount", "B", 8)]
    empty = audits.audit_report(bars.limit(0)).first()
    assert (empty.n_rows, empty.latest_day, empty.no_turnover, empty.no_turnover_ratio, empty.source_gap_likely) == (0, None, 0, 0.0, False)
    assert audits.audit_samples(bars.limit(0)).count() == 0


def test_market_verdict(spark):
    shapes = {"up": lambda i: 10 + i / 10, "down": lambda i: 100 - i / 10, "turned": lambda i: 100 + i / 10 - 20 * (i > 290), "short": lambda i: 10.0 + i}
    rows = [(s, day(i), float(f(i))) for s, f in shapes.items() for i in range(249 if s == "short" else 300)]
    bars = spark.createDataFrame(rows, "symbol string, dt date, close double").withColumns({c: F.col("close") for c in ("open", "high", "low")})

    def verdict(*names):
        rows = audits.market_verdict(bars, spark.createDataFrame([(n,) for n in names], "symbol string")).collect()
        assert len(rows) == len(set(names)) and len({r.verdict for r in rows}) <= 1
        return {r.symbol: r for r in rows}, rows[0].verdict

    each, said = verdict("up", "up")
    assert said == "bull" and each["up"].aligned and round(each["up"].chg20, 6) == round((39.9 / 37.9 - 1) * 100, 6)
    assert verdict("up", "down")[1] == "warn" and verdict("down")[1] == "warn"
    each, said = verdict("up", "short")
    assert said == "unknown" and each["short"].above is None and each["up"].above
    assert verdict("up", "missing")[1] == "unknown"
    each, said = verdict("up", "turned")
    assert each["turned"].above is False and said == "warn"
    dipped = bars.where("symbol = 'up'").withColumn("close", F.when(F.col("dt") > day(294), F.col("close") - 5).otherwise(F.col("close")))
    row = audits.market_verdict(dipped, spark.createDataFrame([("up",)], "symbol string")).first()
    assert (row.above, row.aligned, row.verdict) == (True, False, "mixed")
    assert audits.market_verdict(bars, spark.createDataFrame([], "symbol string")).count() == 0


def test_changes_of_short_histories(spark):
    rows = [("A", day(i), float(100 + i)) for i in range(8)] + [("B", day(0), 50.0), ("C", day(0), 0.0), ("C", day(1), 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, dt date, close double")
    got = {(r.symbol, (r.dt - day(0)).days): (r.a, r.b) for r in bars.select("symbol", "dt", audits.change_of_last(5).alias("a"), audits.change_of_last(20).alias("b")).collect()}
    assert round(got["A", 7][0], 9) == round((107 / 102 - 1) * 100, 9) and round(got["A", 7][1], 9) == 7.0
    assert got["A", 0] == got["B", 0] == (None, None) and got["C", 1] == (None, None)
