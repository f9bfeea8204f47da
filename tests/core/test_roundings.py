"""Roundings and printed numbers at ties, as SQL and C give them; stages of classified results."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round
from quantloom.operators import panels

SF = "/root/testdata/sf0.01"


def test_ties_round_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    # five means of sixteen turnovers as adding leaves them, halves and what no rounding may change
    values = [13.284374999999999, 12.103124999999997, 10.596874999999999, 12.103125, -12.103125, 0.5, -0.000005, 1e305, math.inf, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.v for r in rows.select("i", sql_round("v", 5).alias("v")).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchone()[0] for v in values]
    # the first is not what the shortest decimal says
    assert got[:2] == [13.28438, 12.10312] and rows.select(F.round("v", 5)).first()[0] == 13.28437


def test_printed_halves(spark):
    rows = spark.createDataFrame([(v,) for v in (3.55, 0.25, 0.35, -60.05, None)], "v double")
    panel = rows.select(F.lit("A").alias("symbol"), F.lit(True).alias("above_year"), F.col("v").alias("year_distance"), F.lit(True).alias("in_order"), F.col("v").alias("strength"), F.lit(False).alias("strength_up"), *(F.lit("-").alias(c) for c in ("candle_daily", "candle_weekly", "acc_level")), F.array("v").alias("related"))
    shown = [panels.index_view(panel).collect(), panels.sector_view(panel.limit(1)).collect()]
    assert [r.year for r in shown[0]] == [f"above year line ({v:+.1f}%)" if v is not None else "above year line" for v in (3.55, 0.25, 0.35, -60.05, None)]
    assert shown[1][0].strength == "3.5 down"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_classified_stage_has_no_shifts(spark):
    """The stage in a result is that of r13: the platform's POC, by each bar's own windows, does not count."""
    import __spark_entry__ as entry
    from quantloom.operators import indicators
    from quantloom.plans.structures import classified

    stages = {r.symbol: r.stage for r in indicators.latest(entry.queries()["r13_stage"](spark, SF)).collect()}
    assert {r.symbol: r.stage for r in classified(spark, SF).select("symbol", "stage").collect()} == stages


def test_known_turnover_counts_large_values(spark):
    import datetime as dt

    from quantloom.operators import indicators

    rows = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(i), 1.0, 90.0) for i in range(16)], "symbol string, dt date, high double, turn double")
    from quantloom.plans.catalog import known_turnover

    assert indicators.latest(known_turnover(rows)).first().turn_avg20 == 90.0
    assert indicators.latest(indicators.average_turnover(rows)).first().turn_avg20 is None
