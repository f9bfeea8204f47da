"""Panels of indexes and sectors: price view, candles, strength, accumulation and related symbols of the newest bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quantloom.functions.windows import sql_round
from quantloom.operators import accumulation, indicators, patterns, portfolio, rules

LOOKBACK = 120
VIEW = ("chg5", "chg20", "above_year", "year_distance", "in_order")


def index_panel(bars: DataFrame, weeks: DataFrame, lookback: int = LOOKBACK, keep: int = 3) -> DataFrame:
    """One row for each index: close, changes, year line and order of the averages (unknown before 60 bars), candle summaries of both
    periods and the accumulation's grade and stage."""
    graded = accumulation.accumulation(bars).select("symbol", "dt", "acc_level", "acc_stage")
    view = rules.price_view(indicators.moving_averages(bars, (5, 10, 20, 60, 250)))
    two = [sql_round(c, 2).alias(c) if c in ("chg5", "chg20", "year_distance") else F.col(c) for c in VIEW]
    newest = indicators.latest(view).select("symbol", "dt", sql_round("close", 2).alias("close"), *two)
    candles = patterns.candle_result(bars, weeks, lookback, keep).select("symbol", F.col("summary_daily").alias("candle_daily"), F.col("summary_weekly").alias("candle_weekly"))
    return newest.join(candles, "symbol").join(graded, ["symbol", "dt"]).select("symbol", "dt", "close", *VIEW, "candle_daily", "candle_weekly", "acc_level", "acc_stage")


def sector_analysis(bars: DataFrame, weeks: DataFrame, stocks: DataFrame, relation: DataFrame) -> DataFrame:
    """The panel of each sector with its strength and ``related``: the members that go with it most (symbol, rho), best first."""
    strength = rules.sector_score(bars).select("symbol", "dt", sql_round("sector_score", 2).alias("strength"), F.col("sector_up").alias("strength_up"))
    found = portfolio.related(stocks, indicators.daily_returns(bars), relation)
    related = found.groupBy(F.col("sector").alias("symbol")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol", "rho"))), lambda x: F.struct(x["symbol"].alias("symbol"), x["rho"].alias("rho"))).alias("related"))
    panel = index_panel(bars, weeks).join(strength, ["symbol", "dt"], "left").join(related, "symbol", "left")
    return panel.withColumn("related", F.coalesce("related", F.array().cast("array<struct<symbol:string,rho:double>>")))


@F.udf(StringType())
def _printed(form, value):
    """As C prints a double: by its exact value, halves to the even digit; format_string rounds its shortest decimal instead."""
    return None if value is None else form % value


def year_label(above: Column, distance: Column) -> Column:
    shown = F.when(distance.isNull(), "").otherwise(_printed(F.lit(" (%+.1f%%)"), distance))
    return F.when(above.isNull(), "unknown").otherwise(F.concat(F.when(above, "above year line").otherwise("below year line"), shown))


def index_view(panel: DataFrame) -> DataFrame:
    """The panel as a table of texts; unknown has a text of its own."""
    order = F.when(F.col("in_order"), "in order").when(~F.col("in_order"), "not in order").otherwise("unknown")
    return panel.select("symbol", year_label(F.col("above_year"), F.col("year_distance")).alias("year"), order.alias("averages"), "candle_daily", "candle_weekly", "acc_level")


def sector_view(panel: DataFrame) -> DataFrame:
    """index_view() with the sector's strength and the number of related symbols."""
    strength = F.when(F.col("strength").isNull(), "-").otherwise(F.concat(_printed(F.lit("%.1f"), F.col("strength")), F.when(F.col("strength_up"), " up").otherwise(" down")))
    texts = index_view(panel)
    return texts.join(panel.select("symbol", strength.alias("strength"), F.size("related").alias("n_related")), "symbol").select("symbol", "year", "averages", "strength", "candle_daily", "candle_weekly", "acc_level", "n_related")
