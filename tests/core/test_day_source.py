"""Day files read, streamed and written as a data source; the stored bar table."""

from __future__ import annotations

import datetime as dt
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.sources import day_source, store
from quantloom.sources.files import DAY_RECORD


def put(folder, symbol, days, mode="wb", rest=b""):
    r = np.zeros(len(days), dtype=DAY_RECORD)
    r["day"], r["open"], r["high"], r["low"], r["close"], r["volume"], r["amount"] = days, 1010, 1100, 990, [1000 + i for i in range(len(days))], 12345, 7.5
    pathlib.Path(folder).mkdir(exist_ok=True)
    with open(f"{folder}/{symbol}.day", mode) as f:
        f.write(r.tobytes() + rest)


@pytest.fixture
def source(spark):
    day_source.register(spark)
    return lambda path, **options: spark.read.format("day_files").options(**options).load(str(path))


def test_reads_what_is_valid(source, tmp_path):
    # a day of 0, one before 1990, one that no calendar has, and a record cut off at the end
    put(tmp_path, "600519.SH", [0, 19891231, 20240102, 20230230, 20240229], rest=b"xyz")
    put(tmp_path, "A%2FB", [20240102])
    put(tmp_path, "empty", [])
    (tmp_path / "note.txt").write_text("no bars")
    got = {(r.symbol, r.dt): r for r in source(tmp_path).collect()}
    assert set(got) == {("600519.SH", dt.date(2024, 1, 2)), ("600519.SH", dt.date(2024, 2, 29)), ("A/B", dt.date(2024, 1, 2))}
    r = got["600519.SH", dt.date(2024, 1, 2)]
    assert (r.open, r.high, r.low, r.close, r.volume, r.amount) == (10.1, 11.0, 9.9, 10.02, 123.45, 7.5)
    assert source(tmp_path / "nothing").count() == 0


def test_conditions_choose_files_and_records(source, tmp_path):
    for s in "ABC":
        put(tmp_path, s, [20240101 + i for i in range(20)])
    df = source(tmp_path)
    day = dt.date(2024, 1, 5)
    for condition, n in [
        (F.col("symbol") == "A", 20),
        (F.col("symbol").isin("A", "C", "X"), 40),
        ((F.col("symbol") == "A") & (F.col("symbol") == "B"), 0),
        (F.col("dt") >= day, 48),
        (F.col("dt") > day, 45),
        (F.col("dt") < day, 12),
        (F.col("dt") <= day, 15),
        ((F.col("dt") == day) & (F.col("close") > 10.03), 3),
        (F.col("symbol").isNull(), 0),
    ]:
        assert df.where(condition).count() == n, condition
    reader = day_source.DayReader(str(tmp_path), 1 << 20)
    left = list(reader.pushFilters([day_source.ds.EqualTo(("symbol",), "B"), day_source.ds.GreaterThan(("dt",), day), day_source.ds.GreaterThan(("close",), 1.0)]))
    assert left == [day_source.ds.GreaterThan(("close",), 1.0)]
    assert [[s[0].rsplit("/", 1)[-1] for s in p.slices] for p in reader.partitions()] == [["B.day"]]


def test_tasks_are_packed_and_cut(source, tmp_path):
    assert [p.slices for p in day_source.packed([("a", 0, 2), ("b", 5, 7), ("c", 0, 0), ("d", 0, 1)], 4)] == [[("a", 0, 2), ("b", 5, 2)], [("b", 7, 4)], [("b", 11, 1), ("d", 0, 1)]]
    put(tmp_path, "A", [20240101 + i for i in range(20)])
    cut = source(tmp_path, splitBytes=96)
    assert cut.rdd.getNumPartitions() == 7 and cut.select("dt").distinct().count() == 20


def test_stream_brings_each_record_once(spark, source, tmp_path):
    put(tmp_path / "in", "A", [20240102, 20240103], rest=b"half")
    put(tmp_path / "in", "B", [20240102])

    def turn():
        stream = spark.readStream.format("day_files").load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.symbol, r.dt.day) for r in spark.read.schema(day_source.SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert turn() == [("A", 2), ("A", 3), ("B", 2)]
    # a file grows, one comes later, another stays
    put(tmp_path / "in", "A", [20240102, 20240103, 20240104])
    put(tmp_path / "in", "C", [20240101])
    more = [("A", 2), ("A", 3), ("A", 4), ("B", 2), ("C", 1)]
    assert turn() == more and turn() == more
    # written anew and shorter: delivered from its start
    put(tmp_path / "in", "A", [20240105])
    assert turn() == sorted([*more, ("A", 5)])


def test_writes_and_reads_back(spark, source, tmp_path):
    days = [dt.date(2023, 12, 28) + dt.timedelta(i) for i in range(70)]
    rows = [(s, d, 1.005, 2.0, 0.5, 1.0 + i / 100, 100.0 + i, 3.25) for s in ("A", "x/y", "Ж") for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, day_source.SCHEMA)
    together = bars.repartition(3, "symbol").sortWithinPartitions("symbol", "dt")
    path = str(tmp_path / "days")
    together.write.format("day_files").mode("append").save(path)
    key = lambda df: sorted((r.symbol, r.dt, round(r.close, 2), r.volume, r.amount) for r in df.collect())
    assert key(source(path)) == key(bars)
    assert not [p for p in pathlib.Path(path).iterdir() if p.suffix != ".day"]
    # a symbol's file is replaced, the others stay; overwrite leaves only what is written
    together.where("symbol = 'A' AND dt > '2024-02-01'").write.format("day_files").mode("append").save(path)
    assert {r.symbol: r["count"] for r in source(path).groupBy("symbol").count().collect()} == {"A": 34, "x/y": 70, "Ж": 70}
    together.where("symbol = 'A'").write.format("day_files").mode("overwrite").save(path)
    assert source(path).count() == 70
    with pytest.raises(Exception, match="repartition"):
        bars.repartition(4, "dt").write.format("day_files").mode("append").save(path)
    with pytest.raises(Exception, match="does not fit"):
        together.withColumn("volume", F.lit(-1.0)).write.format("day_files").mode("append").save(path)
    assert source(path).count() == 70 and not [p for p in pathlib.Path(path).iterdir() if p.suffix != ".day"]


def test_store_of_bars(spark, tmp_path):
    path = str(tmp_path / "bars")
    day = lambda i: dt.date(2024, 1, i)
    rows = [(s, day(i), float(i), "x") for s in ("A", "B", None) for i in range(1, 11)]
    bars = spark.createDataFrame(rows, "symbol string, dt date, close double, note string")
    store.store_bars(bars, path, "daily")
    store.store_bars(bars.where("dt = '2024-01-05'"), path, "weekly")
    got = store.load_bars(spark, path, "daily", ["A", "X"], "2024-01-03", day(6))
    assert sorted((r.symbol, r.dt.day, r.close, r.open) for r in got.collect()) == [("A", i, float(i), None) for i in range(3, 7)]
    assert got.columns == ["symbol", "dt", *store.VALUES]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "GreaterThanOrEqual(dt,2024-01-03)" in plan
    # a period is replaced as a whole, the other stays
    store.store_bars(bars.where("symbol = 'B'"), path, "daily")
    assert [store.load_bars(spark, path, p).count() for p in ("daily", "weekly", "monthly")] == [10, 3, 0]


def test_market_increment(spark):
    day = lambda i: dt.date(2024, 1, i)
    names = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    source = spark.createDataFrame([(s, day(i), 1.0) for s in "ABCD" for i in range(1, 11)], "code string, date date, turnover double")
    bars = store.adjusted_source(source)
    assert bars.columns == ["symbol", "dt", "amount"]
    stored = spark.createDataFrame([("A", day(8)), ("A", day(3)), ("B", day(6)), ("D", day(1)), (None, day(1))], "symbol string, dt date")
    # D is stored but not wanted, C wanted but not stored; null is no symbol
    got = store.market_increment(bars, stored, names("A", "B", "B", "C", None))
    assert sorted((r.symbol, r.dt.day) for r in got.collect()) == [("A", 9), ("A", 10), ("B", 7), ("B", 8), ("B", 9), ("B", 10)]
    assert store.market_increment(bars, stored, names("C")).count() == 0
    assert store.market_increment(bars, stored.limit(0), names("A")).count() == 0
