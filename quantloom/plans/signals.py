"""Registered queries of candle variants and results, the main-wave signal, technical details and breakouts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round
from quantloom.operators import indicators as ind
from quantloom.operators import patterns, quality, rules
from quantloom.operators.indicators import rounded
from quantloom.plans import sql
from quantloom.plans.catalog import _K10, _KB, _PASS, _POC, _TR, ORACLE_SQL, register
from quantloom.plans.sql import IND, W, over
from quantloom.sources import bars as src

_GAP, _REST, _STACK, _WAIT = (f"coalesce({_K10[c]}, false)" for c in ("gap_duofangpao", "liangyang_liangyin", "diedie_duofangpao", "duofangpao_pending"))
_SEVEN = "coalesce(rn >= 7 AND yang_6 AND yin_5 AND yang_4 AND yin_3 AND yang_2 AND yin_1 AND yang AND close_4 > close_6 + 1e-9 AND close_2 > close_4 + 1e-9 AND close > close_2 + 1e-9, false)"
_SUPPORT = "least(low_1, low, coalesce(later_low, low))"
_DETAILS = {
    "gap_low": f"CASE WHEN {_GAP} THEN high_3 END", "gap_pct": f"CASE WHEN {_GAP} THEN round((low_2 / high_3 - 1) * 100, 2) END", "gap_support": f"CASE WHEN {_GAP} THEN {_SUPPORT} END",
    "gap_held": f"CASE WHEN {_GAP} THEN {_SUPPORT} >= high_3 - 1e-9 END", "gap_later": f"CASE WHEN {_GAP} THEN later END",
    "rest_ratio": f"CASE WHEN {_REST} THEN round((volume_2 + volume_1) / 2 / volume_3, 2) END", "rest_shrinks": f"CASE WHEN {_REST} THEN (volume_2 + volume_1) / 2 / volume_3 <= 0.85::DOUBLE END",
    "stack_groups": f"CASE WHEN {_STACK} THEN CASE WHEN {_SEVEN} THEN 3 ELSE 2 END END", "stack_rises": f"CASE WHEN {_STACK} THEN low_1 > low_3 + 1e-9 AND (NOT {_SEVEN} OR low_3 > low_5 + 1e-9) END",
    "stack_gain": f"CASE WHEN {_STACK} THEN round((close / CASE WHEN {_SEVEN} THEN close_6 ELSE close_4 END - 1) * 100, 2) END",
    "confirm_at": f"CASE WHEN {_WAIT} THEN greatest(high_2, high_1, high) END", "fail_at": f"CASE WHEN {_WAIT} THEN open_2 END",
}


@register("k10_combo_details", over(f"SELECT symbol, dt, {', '.join(f'{e} AS {c}' for c, e in _DETAILS.items())} FROM kl WHERE {_GAP} OR {_REST} OR {_STACK} OR {_WAIT}", IND, _KB))
def k10_combo_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ["gap_duofangpao", "liangyang_liangyin", "diedie_duofangpao", "duofangpao_pending"]
    flags = patterns.combo_details(patterns.candle_flags(src.bars(spark, sf_dir), codes))
    return flags.where(" OR ".join(codes)).select("symbol", "dt", *_DETAILS)


def _weekly(ctes: str) -> str:
    """CTEs over the weeks instead of the days, under names of their own."""
    return re.sub(r"\b(i1|ind|kb|kl)\b", r"week_\1", ctes.replace("FROM bars ", "FROM res "))


def _summary(name: str, kl: str, e: str, lookback: int = 60) -> str:
    codes = list(patterns.DETECTORS)
    hits = " UNION ALL ".join(f"SELECT symbol, dt, rn, '{c}' AS code, {k} AS place, '{patterns.DETECTORS[c][1]}' AS direction FROM {kl} WHERE {_K10[c]}" for k, c in enumerate(codes))
    return f"""{name}0 AS (SELECT h.*, row_number() OVER (PARTITION BY h.symbol, code ORDER BY h.dt DESC) AS r FROM ({hits}) h JOIN (SELECT symbol, max(rn) AS m FROM {e} GROUP BY 1) e ON e.symbol = h.symbol AND m - h.rn < {lookback}),
{name}1 AS (SELECT symbol, code, place, direction, max(dt) AS dt, count(*) AS n FROM {name}0 WHERE r <= 3 GROUP BY ALL),
{name} AS (SELECT symbol, sum(n) AS n, first(direction ORDER BY dt DESC, place) AS direction, array_to_string(list(code || '(' || strftime(dt, '%m-%d') || ' ' || direction || ')' ORDER BY dt DESC, place)[1:3], ', ') AS summary FROM {name}1 GROUP BY 1)"""


@register("k13_candle_result", over("""SELECT symbol, (coalesce(d.n, 0) + coalesce(k.n, 0))::BIGINT AS n_hits, coalesce(d.direction, k.direction, '-') AS direction, coalesce(d.summary, '-') AS summary_daily, coalesce(k.summary, '-') AS summary_weekly
  FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN d USING (symbol) LEFT JOIN k USING (symbol)""", IND, _KB, sql.weeks(), _weekly(IND), _weekly(_KB), _summary("d", "kl", "ind"), _summary("k", "week_kl", "week_ind")))  # fmt: skip
def k13_candle_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K12's summaries are two of its columns."""
    return patterns.candle_result(src.bars(spark, sf_dir), quality.resample(src.bars(spark, sf_dir, weekdays=False), "week"))


_WEEK = f"""wk AS (SELECT symbol, n >= 10 AND close > m AND sl >= -1e-9 AS anchored FROM (SELECT *, CASE WHEN n >= 63 THEN m - lag(m, 3) OVER w ELSE 0 END AS sl FROM (
  SELECT *, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS n, avg(close) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m FROM res {W}) {W}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1)"""
_BACK = "CASE WHEN close > ma5 THEN rn - max(CASE WHEN close < ma5 THEN rn END) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END"


@register("r4_main_wave_signal", over(f"""SELECT symbol, dt, yearline_pass, coalesce(anchored, false) AS anchored, over_ma5, po5_fan5, yearline_pass AND coalesce(anchored, false) AND (over_ma5 OR po5_fan5) AS main_wave FROM (
  SELECT symbol, dt, {_PASS} AS yearline_pass, coalesce(close > ma5, false) AS over_ma5, coalesce({_BACK} <= 2 AND ma20 - lag(ma20, 2) OVER w > 0, false) AS po5_fan5, lead(dt) OVER w IS NULL AS newest FROM ind {W}) LEFT JOIN wk USING (symbol) WHERE newest""", IND, sql.weeks(), _WEEK))  # fmt: skip
def r4_main_wave_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = rules.break_and_return(rules.yearline_filter(ind.ma_arrangement(ind.moving_averages(src.bars(spark, sf_dir)))))
    weeks = rules.weekly_anchor(quality.resample(src.bars(spark, sf_dir, weekdays=False), "week"))
    made = rules.main_wave_signal(ind.latest(days), ind.latest(weeks))
    return made.select("symbol", "dt", "yearline_pass", "anchored", "over_ma5", "po5_fan5", "main_wave")


@register("r8_technical_detail", over(f"""SELECT symbol, dt, returned AS returned_to_ma5, round(CASE WHEN t > 0 THEN t0 END, 9) AS chip_turn,
  CASE WHEN t IS NULL OR t <= 0 THEN 'missing' WHEN t < 2 THEN 'dense' WHEN t < 5 THEN 'fairly dense' WHEN t < 10 THEN 'loose' ELSE 'very loose' END AS chip_band,
  CASE WHEN NOT coalesce(t > 0 AND len(f) >= 10 AND list_avg(f[-10:]) IS NOT NULL AND list_avg(f[:10]) IS NOT NULL, false) THEN 'unknown' WHEN round(list_avg(f[-10:]), 9) < round(list_avg(f[:10]), 9) THEN 'gathering' ELSE 'spreading' END AS chip_trend
  FROM (SELECT *, coalesce(lag(close) OVER w < ma5p AND close > ma5 AND volume_ratio > 1.5, false) AS returned, avg(turn) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS t0, round(avg(turn) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS t, list(turn) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS f FROM ind {W})""", IND))  # fmt: skip
def r8_technical_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ind.volume_ratio(ind.moving_averages(src.bars(spark, sf_dir)))
    # means of four-digit turnovers have no half at the tenth digit
    return rounded(rules.technical_detail(bars).select("symbol", "dt", "returned_to_ma5", "chip_turn", "chip_band", "chip_trend"), 9)


_PLATFORM = f"""pf AS (SELECT symbol, dt, close, poc + 1.8::DOUBLE * atr AS upper, coalesce(close > poc + 1.8::DOUBLE * atr AND close > open AND (close - low) / (CASE WHEN high = low THEN 0.001 ELSE high - low END) > 0.5 AND NOT lb, false) AS broke,
  row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS lft FROM (SELECT *, {sql.mean("tr2", 14)} AS atr, coalesce(lag(at_limit) OVER w, false) AS lb FROM t1 {W}) JOIN poc USING (symbol, dt)),
at_bar AS (SELECT symbol, max(dt) AS breakout_dt, arg_max(upper, dt) AS support FROM pf WHERE broke AND lft <= 60 GROUP BY 1)"""


@register("r14_breakout_quality", over("""SELECT symbol, dt, breakout_dt, round(support, 5) AS support, least_after,
  CASE WHEN breakout_dt IS NULL THEN 'none' WHEN least_after < support * 0.985::DOUBLE THEN 'false' WHEN least_after <= support * 1.02::DOUBLE THEN 'pullback' ELSE 'direct' END AS quality
  FROM (SELECT symbol, max(dt) AS dt, breakout_dt, support, round(min(close) FILTER (pf.dt > breakout_dt), 5) AS least_after FROM pf LEFT JOIN at_bar USING (symbol) GROUP BY ALL)""", IND, _TR, _POC, _PLATFORM))  # fmt: skip
def r14_breakout_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.breakout_quality(ind.platform(src.bars(spark, sf_dir))))


_NEWEST = lambda name: f"(SELECT * FROM ({ORACLE_SQL[name]}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1)"
#: K3's query is about suppliers; here it is about nations.
_DOUBLE = ORACLE_SQL["k3_double_top_bottom"].replace(sql.SUPPLIER_TICKS, sql.TICKS)


@register("k6_main_pattern", f"""WITH shapes AS (SELECT symbol, 1 AS place, 'head and shoulders ' || kind AS name, 70.0::DOUBLE AS r FROM ({ORACLE_SQL["k2_head_and_shoulders"]}) WHERE kind <> 'none'
  UNION ALL SELECT symbol, 2, 'double ' || kind, 75 FROM ({_DOUBLE}) WHERE kind <> 'none' UNION ALL SELECT symbol, 3, 'triangle ' || triangle, 60 FROM {_NEWEST("k4_triangle")} WHERE triangle <> 'none'
  UNION ALL SELECT symbol, 4, 'wedge ' || wedge, wedge_reliability FROM {_NEWEST("k5_wedge")} WHERE wedge <> 'none'),
best AS (SELECT symbol, name, r FROM shapes WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY r DESC, place) = 1)
SELECT symbol, coalesce(name, 'none') AS main_pattern, coalesce(r, 0) AS reliability, coalesce(r, 0) > 50 AS clear FROM {_NEWEST("k5_wedge")} LEFT JOIN best USING (symbol)""")
def k6_main_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.main_pattern(src.bars(spark, sf_dir)).withColumn("reliability", sql_round("reliability", 2))
