"""Registered queries of the stored bar table, of adjusted sources and of day files as a data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import quality
from quantloom.operators.indicators import rounded
from quantloom.plans import sql
from quantloom.plans.catalog import register
from quantloom.plans.more import scratch
from quantloom.plans.sql import over
from quantloom.sources import bars as src
from quantloom.sources import day_source, store


@register("s1_stored_bars", over("SELECT symbol, dt, open, high, low, close, volume, amount, round(turn, 5) AS turn FROM res WHERE symbol LIKE '%NATION_1%' AND dt BETWEEN DATE '1995-01-06' AND DATE '1996-06-28'", sql.weeks("week")))
def s1_stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and weeks are stored; weeks of some symbols from one day to another are scanned."""
    path = scratch(spark, "bars")
    days = src.bars(spark, sf_dir, weekdays=False)
    store.store_bars(days, path, "daily")
    store.store_bars(quality.resample(store.load_bars(spark, path)), path, "weekly")
    names = [r[0] for r in src.table(spark, sf_dir, "nation").where("n_name LIKE '%NATION_1%'").select("n_name").collect()]
    made = store.load_bars(spark, path, "weekly", names, "1995-01-06", "1996-06-28")
    return rounded(made.select("symbol", "dt", "open", "high", "low", "close", "volume", "amount", "turn"), 5)


_END = "CASE WHEN symbol LIKE '%3' THEN DATE '1998-09-01' ELSE DATE '1998-10-15' END"


@register("s2_market_increment", over(f"""SELECT b.symbol, b.dt, b.open, b.high, b.low, b.close, b.volume, b.amount FROM bars b
  JOIN (SELECT symbol, max(dt) AS e FROM bars WHERE symbol NOT LIKE '%7' AND symbol NOT LIKE '%5' AND dt <= {_END} GROUP BY 1) USING (symbol) WHERE b.dt > e"""))
def s2_market_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored are some symbols to one day, others to another, of some none; a few stored ones are not asked for."""
    path = scratch(spark, "increment")
    bars = src.bars(spark, sf_dir)
    bars.select(F.col("symbol").alias("code"), F.col("dt").alias("date"), "open", "high", "low", "close", "volume", F.col("amount").alias("turnover"), "turn").write.parquet(f"{path}/source")
    source = store.adjusted_source(spark.read.parquet(f"{path}/source"))
    store.store_bars(source.where(f"symbol NOT LIKE '%7' AND dt <= {_END}"), f"{path}/bars", "daily")
    wanted = src.table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol")).where("symbol NOT LIKE '%5'")
    return store.market_increment(source, store.load_bars(spark, f"{path}/bars"), wanted)


_DAY = "symbol, dt, floor(open * 100 + 0.5) / 100 AS open, floor(high * 100 + 0.5) / 100 AS high, floor(low * 100 + 0.5) / 100 AS low, floor(close * 100 + 0.5) / 100 AS close, volume, amount::FLOAT::DOUBLE AS amount FROM bars"


def _write_days(bars: DataFrame, path: str) -> None:
    columns = ["symbol", "dt", "open", "high", "low", "close", "volume", "amount"]
    bars.select(*columns).repartition("symbol").sortWithinPartitions("symbol", "dt").write.format("day_files").mode("append").save(path)


@register("f4_day_files", over(f"SELECT {_DAY} WHERE dt >= DATE '1996-01-01' AND symbol <> 'NATION_3'"))
def f4_day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as day files and read back from a day on; that condition is met by the source."""
    path = scratch(spark, "days")
    day_source.register(spark)
    _write_days(src.bars(spark, sf_dir), path)
    return spark.read.format("day_files").load(path).where("dt >= date'1996-01-01' AND symbol <> 'NATION_3'")


@register("f4_day_stream", over(f"SELECT {_DAY}"))
def f4_day_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day files are streamed, grow by later days and new symbols, and are streamed on: each bar comes once."""
    path = scratch(spark, "days")
    day_source.register(spark)
    src.bars(spark, sf_dir).write.parquet(f"{path}/bars")
    bars = spark.read.parquet(f"{path}/bars")
    for there in ("dt <= date'1996-12-31' AND symbol NOT LIKE '%7'", "true"):
        _write_days(bars.where(there), f"{path}/days")
        stream = spark.readStream.format("day_files").load(f"{path}/days")
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(day_source.SCHEMA).parquet(f"{path}/out")
