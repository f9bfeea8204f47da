"""The stored bar table, and what a source has beyond it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a stored bar has besides its symbol and day.
VALUES = ("open", "high", "low", "close", "volume", "amount", "turn")


def store_bars(bars: DataFrame, path: str, period: str) -> None:
    """Store the bars of a period in place of those stored; other periods stay. Values that ``bars`` lacks are null, further columns
    are not stored. Files hold ranges of symbols, each in order of days, so a condition on the symbol passes over most row groups."""
    values = [(F.col(c).cast("double") if c in bars.columns else F.lit(None).cast("double")).alias(c) for c in VALUES]
    rows = bars.select("symbol", "dt", *values, F.lit(period).alias("period")).repartitionByRange("symbol", "dt").sortWithinPartitions("symbol", "dt")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def load_bars(spark: SparkSession, path: str, period: str = "daily", symbols: Iterable[str] | None = None, start: dt.date | str | None = None, end: dt.date | str | None = None) -> DataFrame:
    """Stored bars of a period, of some symbols or all, from ``start`` to ``end`` (both included). The period chooses a folder, the
    rest is pushed to the scan. An unknown period or symbol has no rows. Rows come in no order; ``orderBy`` where it matters."""
    bars = spark.read.parquet(path).where(F.col("period") == period).drop("period")
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    if start is not None:
        bars = bars.where(F.col("dt") >= F.to_date(F.lit(start)))
    if end is not None:
        bars = bars.where(F.col("dt") <= F.to_date(F.lit(end)))
    return bars


def adjusted_source(rows: DataFrame) -> DataFrame:
    """Rows of a store of adjusted bars (code, date, turnover for the amount) under the engine's names; columns that a bar does not
    have are left out."""
    renamed = rows.withColumnsRenamed({"code": "symbol", "date": "dt", "turnover": "amount"})
    kept = {"symbol", "dt", *VALUES} - {"turn"}
    return renamed.select(*(c for c in renamed.columns if c in kept))


def market_increment(source: DataFrame, stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bars of ``source`` that are newer than the last stored one of their symbol, for the wanted symbols (a column symbol).

    The scan starts after the oldest of these last days; a symbol with nothing stored does not count there, as it would turn
    the increment into a scan of the whole source, and gets no rows here: it is fetched whole, apart. Without any stored bar
    the increment is empty.
    """
    names = wanted.select("symbol").where("symbol is not null").distinct()
    ends = stored.join(names, "symbol", "left_semi").groupBy("symbol").agg(F.max("dt").alias("_end"))
    oldest = ends.agg(F.min("_end")).first()[0]
    newer = source.where(F.lit(False) if oldest is None else F.col("dt") > F.lit(oldest))
    return newer.join(ends, "symbol").where(F.col("dt") > F.col("_end")).drop("_end")
