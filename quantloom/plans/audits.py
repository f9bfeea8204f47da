"""Registered queries of audits over a whole table and of the market verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import audits
from quantloom.operators.indicators import rounded
from quantloom.plans import sql
from quantloom.plans.catalog import _SECTOR, register
from quantloom.plans.sql import IND, W, over
from quantloom.sources import bars as src

#: Bars as a poor feed brings them, in both engines' words: no close, no amount, a high below the low, no turnover, repeated days.
_FAULTS = {
    "close": "CASE WHEN day(dt) = 13 AND symbol LIKE '%2' THEN NULL ELSE close END",
    "amount": "CASE WHEN day(dt) = 7 AND symbol LIKE '%4' THEN 0 ELSE amount END",
    "high": "CASE WHEN day(dt) = 21 AND symbol LIKE '%6' THEN low / 2 ELSE high END",
    "turn": "CASE WHEN symbol LIKE '%1%' THEN NULL ELSE turn END",
}
_TWICE = "day(dt) = 28 AND symbol LIKE '%8'"
_COLUMNS = ", ".join(f"{_FAULTS.get(c, c)} AS {c}" for c in ("symbol", "dt", "open", "high", "low", "close", "volume", "amount", "turn"))
_POOR = f"poor AS (SELECT {_COLUMNS} FROM bars UNION ALL SELECT {_COLUMNS} FROM bars WHERE {_TWICE})"
_BAD = """bad AS (SELECT *, row_number() OVER (PARTITION BY symbol, dt) = 1 AND count(*) OVER (PARTITION BY symbol, dt) > 1 AS duplicate_key, close IS NULL OR close <= 0 AS bad_close,
  coalesce(high < low OR high < open OR high < close OR low > open OR low > close OR open <= 0 OR low <= 0 OR high <= 0, false) AS invalid_ohlc,
  volume > 0 AND coalesce(amount, 0) <= 0 AS volume_no_amount, dt - lag(dt) OVER (PARTITION BY symbol ORDER BY dt) AS gap FROM poor)"""
_LATE = "late AS (SELECT * FROM poor WHERE dt = (SELECT max(dt) FROM poor))"


def poor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = src.bars(spark, sf_dir)
    return bars.unionByName(bars.where(_TWICE)).withColumns({c: F.expr(e) for c, e in _FAULTS.items()})


@register("a4_audit_report", over("""SELECT * FROM (SELECT count(*) AS n_rows, count(*) FILTER (duplicate_key) AS duplicate_key, count(*) FILTER (bad_close) AS bad_close, count(*) FILTER (invalid_ohlc) AS invalid_ohlc,
    count(*) FILTER (volume_no_amount) AS volume_no_amount, count(*) FILTER (gap > 7) AS long_gap FROM bad),
  (SELECT max(dt) AS latest_day, count(*) FILTER (coalesce(turn, 0) <= 0 AND volume > 0) AS no_turnover, round(count(*) FILTER (coalesce(turn, 0) <= 0 AND volume > 0) / count(*), 4) AS no_turnover_ratio,
    count(*) FILTER (coalesce(turn, 0) <= 0 AND volume > 0) / count(*) > 0.5 AS source_gap_likely FROM late)""", _POOR, _BAD, _LATE))  # fmt: skip
def a4_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.audit_report(poor_bars(spark, sf_dir))


@register("a4_audit_samples", over("""SELECT "check", symbol, dt, value FROM (SELECT 'duplicate_key' AS "check", symbol, dt, NULL::DOUBLE AS value FROM bad WHERE duplicate_key UNION ALL SELECT 'bad_close', symbol, dt, close FROM bad WHERE bad_close
  UNION ALL SELECT 'invalid_ohlc', symbol, dt, close FROM bad WHERE invalid_ohlc UNION ALL SELECT 'volume_no_amount', symbol, dt, volume FROM bad WHERE volume_no_amount UNION ALL SELECT 'long_gap', symbol, dt, gap FROM bad WHERE gap > 7
  UNION ALL SELECT 'no_turnover', symbol, dt, turn FROM late WHERE coalesce(turn, 0) <= 0 AND volume > 0) QUALIFY row_number() OVER (PARTITION BY "check" ORDER BY symbol, dt, value NULLS FIRST) <= 20""", _POOR, _BAD, _LATE))  # fmt: skip
def a4_audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample is what this operator reports: the first findings of each check."""
    return audits.audit_samples(poor_bars(spark, sf_dir), 20)


@register("r22_market_verdict", over("""SELECT *, CASE WHEN (SELECT count(*) FROM e WHERE above IS NULL) > 0 THEN 'unknown' WHEN (SELECT bool_and(above AND aligned) FROM e) THEN 'bull' WHEN (SELECT bool_or(NOT above) FROM e) THEN 'warn' ELSE 'mixed' END AS verdict FROM e""",
    IND, """e AS (SELECT symbol, dt, close, round(ma250, 5) AS ma250, close > ma250 AS above, ma5 > ma20 AND ma20 > ma60 AND ma60 > ma250 AS aligned, round(change20, 5) AS chg20
      FROM (SELECT r_name AS symbol FROM region WHERE r_regionkey < 2) LEFT JOIN (SELECT * FROM ind WHERE ma250 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1) USING (symbol))""", ticks=sql.SECTOR_TICKS))  # fmt: skip
def r22_market_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions are the market's anchors."""
    anchors = src.table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_name").alias("symbol"))
    return rounded(audits.market_verdict(src.bars(spark, sf_dir, "r_name"), anchors), exact=("close",))


def _change(n: int) -> str:
    return f"round((CASE WHEN lag(close) OVER w IS NOT NULL THEN close / nullif(first_value(close) OVER (w ROWS BETWEEN {n} PRECEDING AND CURRENT ROW), 0) - 1 END) * 100, 5) AS chg{n}"


@register("x6_sector_table", over(f"SELECT symbol, round(sc, 5) AS sector_score, chg5, chg10, chg20 FROM (SELECT symbol, dt, {_change(5)}, {_change(10)}, {_change(20)} FROM bars {W} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1) JOIN z USING (symbol, dt)", _SECTOR, ticks=sql.SECTOR_TICKS))
def x6_sector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audits.sector_strength(src.bars(spark, sf_dir, "r_name")))
