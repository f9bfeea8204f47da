"""Registered queries of stored scans, second passes, late bars and appended streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round
from quantloom.operators import indicators as ind
from quantloom.operators import rules
from quantloom.operators.indicators import rounded
from quantloom.plans import verdicts as _verdict_sql  # noqa: F401  gives v9 its SQL
from quantloom.plans.catalog import _PASS, ORACLE_SQL, register
from quantloom.plans.jobs import _verdicts
from quantloom.plans.more import scratch
from quantloom.plans.sql import IND, over
from quantloom.sources import bars as src
from quantloom.streaming import scans

_SCAN = "symbol string, dt date, close double, ma20 double, yearline_pass boolean"


def evaluate(bars: DataFrame) -> DataFrame:
    """The scan of these queries: the year-line verdict of each symbol's newest bar."""
    made = rules.yearline_filter(ind.ma_arrangement(ind.moving_averages(bars)))
    return ind.latest(made).select("symbol", "dt", "close", "ma20", "yearline_pass")


@register("n5_scan_flush", over(f"SELECT symbol, dt, close, round(ma20, 5) AS ma20, {_PASS} AS yearline_pass FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1", IND))
def n5_scan_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations are scanned in four batches; bars are written once and read by each."""
    path = scratch(spark, "scan")
    src.bars(spark, sf_dir).write.parquet(f"{path}/bars")
    bars = spark.read.parquet(f"{path}/bars")
    bars.select("symbol").distinct().repartition(4, "symbol").write.parquet(f"{path}/symbols")
    symbols = spark.readStream.schema("symbol string").option("maxFilesPerTrigger", 1).parquet(f"{path}/symbols")
    scans.run_scan(symbols, f"{path}/store", f"{path}/state", "1", lambda todo: evaluate(bars.join(todo, "symbol", "left_semi")), _SCAN)
    return rounded(scans.stored_results(spark, f"{path}/store", "1", _SCAN).select("symbol", "dt", "close", "ma20", "yearline_pass"))


@register("n6_second_pass", ORACLE_SQL["v9_portfolio_evaluation"])
def n6_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts stored by a scan get the portfolio's sizes; the pass runs twice, as a restart would."""
    path, first = scratch(spark, "store"), "symbol string, entry double, stop double, verdict string"
    whole = first + ", shares long, reason string, risk double, scale double, suggested_shares long, suggested_risk double"
    verdicts = _verdicts(spark, sf_dir).select("symbol", "entry", "stop", "verdict")
    scans.flush(src.table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol")), path, "1", lambda todo: verdicts.join(todo, "symbol", "left_semi"), first)
    returns = ind.daily_returns(src.bars(spark, sf_dir))
    for schema in (first, whole):
        scans.second_pass(spark, path, "1", lambda rows: scans.add_portfolio(rows, returns, lot=1), schema)
    made = scans.stored_results(spark, path, "1", whole)
    return made.select("symbol", "verdict", "shares", "suggested_shares", "suggested_risk", sql_round("scale", 4).alias("scale"))


_LATE = "(symbol LIKE '%3' AND dt > DATE '1998-10-20')"


@register("n7_late_bars", over(f"""SELECT symbol, dt, close, round(ma20, 5) AS ma20, {_PASS} AS yearline_pass, symbol LIKE '%3' AND (symbol IN (SELECT symbol FROM bars WHERE dt > DATE '1998-11-05') OR symbol IN (SELECT symbol FROM bars
   JOIN (SELECT symbol, max(dt) AS e FROM bars WHERE dt <= DATE '1998-11-05' GROUP BY 1) USING (symbol) WHERE {_LATE} AND dt BETWEEN e - 15 AND e)) AS recomputed FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1""", IND))  # fmt: skip
def n7_late_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some symbols are stored to 5 November 1998, with wrong closes on the last days; the source has them right and goes on. All
    other symbols are stored as the source has them, and their results stay."""
    path = scratch(spark, "late")
    src.bars(spark, sf_dir).write.parquet(f"{path}/source")
    source = spark.read.parquet(f"{path}/source")
    wrong = F.when(F.expr(_LATE), F.col("close") * 1.5).otherwise(F.col("close"))
    source.where("symbol NOT LIKE '%3' OR dt <= date'1998-11-05'").withColumn("close", wrong).write.parquet(f"{path}/stored")
    stored = spark.read.parquet(f"{path}/stored")
    evaluate(stored).write.parquet(f"{path}/results")
    bars, touched = scans.late_bars(stored, source)
    return rounded(scans.refresh(spark.read.parquet(f"{path}/results"), bars, touched, evaluate))


@register("n1_appended_bars", """SELECT event_type AS code, '30m' AS period, time_bucket(INTERVAL '30 minutes', ts) AS dt, arg_max(value, ROW(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL""")
def n1_appended_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose files overlap: each brings its week's bars and those of the day before again."""
    path = scratch(spark, "append")
    bars = src.minute_bars(src.table(spark, sf_dir, "events")).select("code", F.lit("30m").alias("period"), "dt", "close", "volume")
    week = F.date_trunc("week", "dt").cast("date")
    again = bars.select("*", week.alias("pull")).unionByName(bars.select("*", F.date_trunc("week", F.col("dt") + F.expr("interval 1 day")).cast("date").alias("pull")))
    again.write.partitionBy("pull").parquet(f"{path}/bars")
    schema = "code string, period string, dt timestamp, close double, volume long, pull date"
    stream = scans.append_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{path}/bars").drop("pull"), "60 days")
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").withColumn("dt", F.col("dt").cast("timestamp_ntz"))
