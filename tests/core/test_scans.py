"""Stored scans that are cut off and go on, passes over stored rows, late bars, appended streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.streaming import scans

DAY = dt.date(2024, 1, 1)
SCHEMA = "symbol string, score double"
NAMES = [f"S{i:02d}" for i in range(12)]


def symbol_stream(spark, path):
    return spark.readStream.schema("symbol string").option("maxFilesPerTrigger", 1).parquet(path)


def rows(spark, store, schema=SCHEMA, job="7"):
    return sorted(tuple(r) for r in scans.stored_results(spark, store, job, schema).select(*[c.split()[0] for c in schema.split(", ")]).collect())


@pytest.fixture
def symbols(spark, tmp_path):
    for i in range(4):
        spark.createDataFrame([(s,) for s in NAMES[i * 3 : i * 3 + 3]], "symbol string").coalesce(1).write.mode("append").parquet(str(tmp_path / "symbols"))
    return str(tmp_path / "symbols")


def test_scan_goes_on_after_a_cut(spark, tmp_path, symbols):
    """A batch that fails, one whose rows are stored but not its checkpoint, and a fresh checkpoint: each symbol once."""
    store, seen = str(tmp_path / "store"), []

    def evaluate(todo, fails_at=None):
        names = sorted(r.symbol for r in todo.collect())
        seen.append(names)
        if len(seen) == fails_at:
            raise RuntimeError("cut off")
        return todo.where("symbol <> 'S05'").select("symbol", F.substring("symbol", 2, 2).cast("double").alias("score"))

    with pytest.raises(Exception, match="cut off"):
        scans.run_scan(symbol_stream(spark, symbols), store, str(tmp_path / "state"), "7", lambda t: evaluate(t, fails_at=3), SCHEMA)
    assert len(rows(spark, store)) in (5, 6)
    scans.run_scan(symbol_stream(spark, symbols), store, str(tmp_path / "state"), "7", evaluate, SCHEMA)
    want = [(s, float(s[1:])) for s in NAMES if s != "S05"]
    assert rows(spark, store) == want
    assert seen[2] == seen[3]  # the batch that was cut off comes again
    seen.clear()
    scans.run_scan(symbol_stream(spark, symbols), store, str(tmp_path / "other"), "7", evaluate, SCHEMA)
    assert rows(spark, store) == want
    assert [s for names in seen for s in names] == ["S05"]  # what failed is tried again, nothing else
    # rows of a flush that was stored in part are replaced, not added to
    again = spark.createDataFrame([(s,) for s in NAMES], "symbol string")
    scans.flush(again, store, "8", evaluate, SCHEMA)
    scans.flush(again, store, "8", evaluate, SCHEMA)
    assert rows(spark, store, job="8") == want and rows(spark, store) == want and rows(spark, store, job="9") == []


def test_second_pass(spark, tmp_path):
    """Repeatable, also when it was cut off between its two moves; other jobs' rows stay."""
    store = str(tmp_path / "store")
    for job in ("7", "8"):
        scans.flush(spark.createDataFrame([(s,) for s in NAMES[:4]], "symbol string"), store, job, lambda t: t.withColumn("score", F.lit(2.0)), SCHEMA)
    whole = SCHEMA + ", share double"
    share = lambda r: r.drop("share").withColumn("share", F.col("score") / r.count())
    for schema in (SCHEMA, whole, whole):
        scans.second_pass(spark, store, "7", share, schema)
        assert rows(spark, store, whole) == [(s, 2.0, 0.5) for s in NAMES[:4]]
    (tmp_path / "store" / "_before").mkdir(exist_ok=True)
    (tmp_path / "store" / "job_id=7").rename(tmp_path / "store" / "_before" / "job_id=7")
    assert rows(spark, store, whole) == [(s, 2.0, 0.5) for s in NAMES[:4]]
    assert rows(spark, store, job="8") == [(s, 2.0) for s in NAMES[:4]]


def test_portfolio_pass(spark):
    """Two candidates that move together share the limit; an earlier pass's columns are replaced."""
    returns = spark.createDataFrame([(s, DAY + dt.timedelta(i), (i % 5 - 2) * 0.01) for s in "AB" for i in range(40)], "symbol string, dt date, ret double")
    stored = spark.createDataFrame([("A", 100.0, 90.0, "candidate"), ("B", 50.0, 49.0, "candidate"), ("C", 10.0, 9.0, "watch"), ("D", None, None, "avoid")], "symbol string, entry double, stop double, verdict string")
    once = scans.add_portfolio(stored, returns, equity=1e5, risk=0.05, most=1.0)
    twice = scans.add_portfolio(once, returns, equity=1e5, risk=0.05, most=1.0)
    got = {r.symbol: r for r in twice.collect()}
    assert once.columns == twice.columns and sorted(map(str, once.collect())) == sorted(map(str, got.values()))
    # 5,000 and 2,000 at risk, rho 1: 7,000 against a limit of 6 % of 100,000
    assert got["A"].shares == 500 and got["B"].shares == 2000
    assert got["A"].scale == pytest.approx(6000 / 7000) and got["A"].suggested_shares == 400 and got["B"].suggested_shares == 1700
    assert got["C"].suggested_shares == 0 and got["D"].shares == 0 and got["D"].reason == "stop not below entry"


def test_late_bars(spark):
    """A close corrected ten days back changes its symbol's result alone; older corrections are outside the window."""
    bars = [(s, DAY + dt.timedelta(i), float(i)) for s in "ABCD" for i in range(40)]
    stored = spark.createDataFrame([b for b in bars if b[0] != "D"], "symbol string, dt date, close double")
    right = {("A", DAY + dt.timedelta(29)): 99.0, ("B", DAY + dt.timedelta(10)): 77.0}
    source = spark.createDataFrame([(s, d, right.get((s, d), c)) for s, d, c in bars], "symbol string, dt date, close double")
    evaluated = []

    def evaluate(b):
        evaluated.extend(r.symbol for r in b.select("symbol").distinct().collect())
        return b.groupBy("symbol").agg(F.max("close").alias("top"), F.count(F.lit(1)).alias("n"))

    results = evaluate(stored)
    evaluated.clear()
    made, touched = scans.late_bars(stored, source)
    assert sorted(r.symbol for r in touched.collect()) == ["A", "D"]
    assert {(r.symbol, r.dt): r.close for r in made.collect()} == {(s, d): right.get((s, d), c) if s == "A" else c for s, d, c in bars}
    got = {r.symbol: (r.top, r.n, r.recomputed) for r in scans.refresh(results, made, touched, evaluate).collect()}
    assert sorted(evaluated) == ["A", "D"]
    assert got == {"A": (99.0, 40, True), "B": (39.0, 40, False), "C": (39.0, 40, False), "D": (39.0, 40, True)}


def test_nulls_and_repetition_in_late_bars(spark):
    stored = spark.createDataFrame([("A", DAY, 1.0, 2.0), ("B", DAY, None, 2.0)], "symbol string, dt date, close double, turn double")
    source = spark.createDataFrame([("A", DAY, 1.0, None), ("B", DAY, None, 2.0)], "symbol string, dt date, close double, turn double")
    made, touched = scans.late_bars(stored, source, keep_old=("turn",))
    assert [r.symbol for r in touched.collect()] == ["A"]
    assert sorted(map(tuple, made.collect())) == [("A", DAY, 1.0, 2.0), ("B", DAY, None, 2.0)]


def test_appended_stream_passes_each_bar_once(spark, tmp_path):
    path, out = str(tmp_path / "bars"), str(tmp_path / "out")
    at = lambda i: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=30 * i)
    schema = "code string, period string, dt timestamp, close double"

    def pull(lo, hi):
        spark.createDataFrame([("A", p, at(i), float(i)) for p in ("30m", "60m") for i in range(lo, hi)], schema).coalesce(1).write.mode("append").parquet(path)
        stream = scans.append_stream(spark.readStream.schema(schema).parquet(path))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.period, r.close) for r in spark.read.parquet(out).collect())

    assert pull(0, 5) == [(p, float(i)) for p in ("30m", "60m") for i in range(5)]
    assert pull(2, 8) == [(p, float(i)) for p in ("30m", "60m") for i in range(8)]


def test_upsert_does_not_depend_on_the_order_of_rows(spark):
    """Of new rows with one key the highest sequence wins, unknown ones last; without a sequence the highest row."""
    from quantloom.operators import quality

    stored = spark.createDataFrame([("A", 1, 5.0), ("B", 2, 6.0)], "k string, v int, turn double")
    new = spark.createDataFrame([("A", 7, None, 1), ("A", 3, None, 2), ("A", 9, None, None), ("C", 4, 1.0, 1)], "k string, v int, turn double, seq int")
    for rows in (new, new.orderBy(F.desc("v")).coalesce(1), new.repartition(3)):
        made = quality.upsert(stored, rows, ["k"], ["turn"], order="seq")
        assert made.columns == ["k", "v", "turn"] and sorted(map(tuple, made.collect())) == [("A", 3, 5.0), ("B", 2, 6.0), ("C", 4, 1.0)]
        assert sorted(map(tuple, quality.upsert(stored, rows.drop("seq"), ["k"], ["turn"]).collect())) == [("A", 9, 5.0), ("B", 2, 6.0), ("C", 4, 1.0)]
