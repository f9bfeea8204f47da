"""Registered queries of accumulation, and of the panels of indexes and sectors that are put together from other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round
from quantloom.operators import accumulation as acc
from quantloom.operators import indicators as ind
from quantloom.operators import panels, quality, rules, waves
from quantloom.operators.indicators import rounded
from quantloom.plans import sql
from quantloom.plans.catalog import _KB, ORACLE_SQL, _SECTOR, j1_primary_sector, known_turnover, register
from quantloom.plans.signals import _summary, _weekly
from quantloom.plans.sql import IND, W, over
from quantloom.sources import bars as src

_F = lambda c, f, n: f"{f}({c}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
#: Grades of all bars; stage, chips and turnover are what the caller knows.
def _acc(stage: str = "'unknown'", turn: str = "NULL::DOUBLE", source: str = "ind") -> str:
    points = """CASE WHEN low THEN 30 ELSE 0 END + CASE WHEN flat THEN 15 ELSE 0 END + CASE WHEN vs IN ('settling', 'mild rise') THEN 25 WHEN vs = 'dried up' THEN 12 ELSE 0 END + CASE WHEN small THEN 8 ELSE 0 END
  + CASE stg WHEN 'accumulation' THEN 20 WHEN 'pressed accumulation' THEN 12 WHEN 'shakeout' THEN 8 ELSE 0 END + CASE WHEN tn < 2 OR tn BETWEEN 3 AND 5 THEN 8 ELSE 0 END"""
    return f"""ac0 AS (SELECT *, {stage} AS known, {turn} AS tn, CASE WHEN rn >= 21 THEN (close - lag(close, 20) OVER w) / lag(close, 20) OVER w END AS t, round(1 - close / {_F("close", "max", 120)}, 4) AS re, {_F("close", "max", 120)} AS h, {_F("close", "min", 120)} AS l,
  CASE WHEN rn >= 25 THEN round({_F("volume", "avg", 5)} / avg(volume) OVER (w ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING), 3) END AS vt, CASE WHEN rn >= 20 THEN round(({_F("high", "max", 20)} - {_F("low", "min", 20)}) / {_F("close", "avg", 20)}, 4) END AS am, CASE WHEN rn >= 250 THEN close > ma250 END AS ay FROM {source} {W}),
ac1 AS (SELECT *, CASE WHEN vt < 0.5 THEN 'dried up' WHEN vt < 0.9 THEN 'settling' WHEN vt <= 1.1 THEN 'usual' WHEN vt <= 1.5 THEN 'mild rise' WHEN vt IS NOT NULL THEN 'heavy' ELSE 'unknown' END AS vs, CASE WHEN h - l > 1e-9 THEN (close - l) / (h - l) END AS po FROM ac0),
ac2 AS (SELECT *, coalesce(po <= 0.2, false) AS nl, coalesce(po >= 0.85, false) AS top, coalesce(vt > 1.1, false) AS more, coalesce(abs(t) <= 0.05, false) AS flat, coalesce(am < 0.2, false) AS small, coalesce(re >= 0.15, false) OR coalesce(po <= 0.2, false) AS low_ FROM ac1),
ac3 AS (SELECT * REPLACE (low_ AS low), CASE WHEN known <> 'unknown' THEN known WHEN top AND more AND t < 0.05 THEN 'distribution' WHEN t > 0.08 THEN 'rally' WHEN flat AND more AND low_ THEN 'accumulation' WHEN low_ AND t < -0.03 AND more THEN 'pressed accumulation' WHEN flat AND small THEN 'consolidation' ELSE 'unknown' END AS stg FROM (SELECT * FROM ac2)),
ac4 AS (SELECT *, {points} AS pts FROM ac3),
ac AS (SELECT *, CASE WHEN rn < 30 THEN 'unknown' WHEN stg IN ('distribution', 'rally') THEN 'none' WHEN pts >= 75 AND low AND flat AND vs IN ('settling', 'mild rise') AND coalesce(ay, true) THEN 'strong' WHEN pts >= 45 THEN 'medium' WHEN pts >= 20 THEN 'weak' ELSE 'none' END AS level FROM ac4)"""


_SHOW = """SELECT symbol, dt, level AS acc_level, CASE WHEN rn >= 30 THEN pts END::INT AS acc_points, CASE WHEN rn >= 30 THEN stg ELSE known END AS acc_stage, CASE WHEN rn >= 30 THEN round(re * 100, 2) END AS retrace_pct, rn >= 30 AND nl AS near_low, ay AS above_year,
  vt AS volume_trend, vs AS volume_state, CASE WHEN rn >= 30 THEN round(t * 100, 2) END AS chg20, am AS amplitude20, CASE WHEN rn < 30 THEN '' ELSE concat_ws(', ', CASE WHEN low THEN 'low' WHEN top THEN 'high' END, CASE WHEN flat THEN 'flat' END, CASE WHEN vs <> 'unknown' THEN 'volume ' || vs END, CASE WHEN small THEN 'small range' END,
  CASE WHEN stg <> 'unknown' THEN 'stage ' || stg END, CASE WHEN tn < 2 THEN 'turnover settles' END, CASE WHEN tn BETWEEN 3 AND 5 THEN 'turnover gathers' END, CASE WHEN ay THEN 'above year line' WHEN NOT ay THEN 'below year line' END) END AS acc_evidence FROM ac"""
_ACC_COLUMNS = ("acc_level", "acc_points", "acc_stage", "retrace_pct", "near_low", "above_year", "volume_trend", "volume_state", "chg20", "amplitude20")


@register("r15_accumulation", over(_SHOW, IND, _acc(turn="round(turn_ma20, 9)")))
def r15_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks, with their mean turnover; the stage follows from the bars."""
    b = ind.turnover_stats(src.bars(spark, sf_dir))
    made = acc.accumulation(b, turnover=F.col("turn_ma20"))
    return made.select("symbol", "dt", *_ACC_COLUMNS, F.array_join("acc_evidence", ", ").alias("acc_evidence"))


@register("r15_sector_accumulation", over(_SHOW, IND, _acc(), ticks=sql.SECTOR_TICKS))
def r15_sector_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = acc.accumulation(src.bars(spark, sf_dir, "r_name"))
    return made.select("symbol", "dt", *_ACC_COLUMNS, F.array_join("acc_evidence", ", ").alias("acc_evidence"))


@register("r16_result_accumulation", f"""SELECT symbol, CASE WHEN stage IN ('distribution', 'rally') THEN 'none' WHEN pts >= 45 THEN 'medium' WHEN pts >= 20 THEN 'weak' ELSE 'none' END AS acc_level, pts::INT AS acc_points, round(re * 100, 2) AS retrace_pct, true AS acc_known FROM (
  SELECT symbol, stage, re, CASE WHEN coalesce(re >= 0.15, false) OR chip THEN 30 ELSE 0 END + CASE WHEN stage IN ('accumulation', 'consolidation') THEN 15 ELSE 0 END + CASE stage WHEN 'accumulation' THEN 28 WHEN 'shakeout' THEN 8 ELSE 0 END + CASE WHEN chip THEN 20 ELSE 0 END + CASE WHEN tn < 2 OR tn BETWEEN 3 AND 5 THEN 8 ELSE 0 END AS pts FROM (
  SELECT *, round(1 - price / high120, 4) AS re, coalesce(tn < 2 AND round(1 - price / high120, 4) >= 0.15, false) AS chip FROM (SELECT symbol, dt, stage FROM ({ORACLE_SQL["r13_stage"]}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1) JOIN
  (SELECT symbol, dt, turn_avg20 AS tn, high120 FROM ({ORACLE_SQL["w18_average_turnover"]})) USING (symbol, dt) JOIN (SELECT symbol, dt, close AS price FROM ({ORACLE_SQL["r1_yearline_filter"]})) USING (symbol, dt)))""")
def r16_result_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored results of the newest bars: stage, mean turnover, price and high, year line, chips."""
    b = waves.stage(known_turnover(rules.yearline_filter(ind.ma_arrangement(ind.moving_averages(src.bars(spark, sf_dir))))))
    newest = ind.latest(rounded(b.select("symbol", "dt", "stage", "turn_avg20", "high120", "close", "yearline_pass"), exact=("high120", "close")))
    results = newest.select("symbol", "stage", F.col("turn_avg20").alias("turnover_20"), F.col("close").alias("price"), F.col("high120").alias("high_120"), "yearline_pass").withColumns(
        {"chip_low": (F.col("turnover_20") < 2) & (sql_round(1 - F.col("price") / F.col("high_120"), 4) >= acc.LOW_RETRACE), "chip_low_unknown": F.col("turnover_20").isNull()}
    )
    return acc.from_results(results).select("symbol", "acc_level", "acc_points", "retrace_pct", "acc_known")


_VIEW = f"""pv AS (SELECT symbol, dt, close, rn, round((close / lag(close, 5) OVER w - 1) * 100, 2) AS chg5, round((close / lag(close, 20) OVER w - 1) * 100, 2) AS chg20, close > ma250 AS above_year, round((close / ma250 - 1) * 100, 2) AS year_distance,
  CASE WHEN ma60 IS NOT NULL THEN ma5 >= ma10 AND ma10 >= ma20 AND ma20 >= ma60 END AS in_order, lead(dt) OVER w IS NULL AS newest FROM ind {W})"""
_CANDLES = (_KB, sql.weeks(), _weekly(IND), _weekly(_KB), _summary("d", "kl", "ind", 120), _summary("k", "week_kl", "week_ind", 120))
_PANEL = """p.symbol, p.dt, round(p.close, 2) AS close, chg5, p.chg20, p.above_year, year_distance, in_order, coalesce(d.summary, '-') AS candle_daily, coalesce(k.summary, '-') AS candle_weekly, ac.level AS acc_level, CASE WHEN p.rn >= 30 THEN stg ELSE known END AS acc_stage"""
_PARTS = "pv p JOIN ac ON ac.symbol = p.symbol AND ac.dt = p.dt LEFT JOIN d ON d.symbol = p.symbol LEFT JOIN k ON k.symbol = p.symbol"


@register("x4_index_panel", over(f"SELECT {_PANEL} FROM {_PARTS} WHERE newest", IND, _acc(), _VIEW, *_CANDLES, ticks=sql.SECTOR_TICKS))
def x4_index_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are the indexes."""
    return panels.index_panel(src.bars(spark, sf_dir, "r_name"), quality.resample(src.bars(spark, sf_dir, "r_name", weekdays=False), "week"))


_SREL = "(SELECT symbol AS sector, list({'symbol': r, 'rho': rho} ORDER BY rank) AS related FROM (SELECT sector AS symbol, symbol AS r, rho, rank FROM (" + ORACLE_SQL["x3_related_symbols"] + ")) GROUP BY 1)"


@register("x1_sector_analysis", over(f"""SELECT {_PANEL}, round(sc, 2) AS strength, sc > 12.5 AS strength_up, coalesce(len(related), 0)::INT AS n_related, related[1].symbol AS closest FROM {_PARTS} LEFT JOIN z ON z.symbol = p.symbol AND z.dt = p.dt LEFT JOIN {_SREL} x ON x.sector = p.symbol WHERE newest""",
    IND, _acc(), _VIEW, *_CANDLES, _SECTOR, ticks=sql.SECTOR_TICKS))
def x1_sector_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, weeks = src.bars(spark, sf_dir, "r_name"), quality.resample(src.bars(spark, sf_dir, "r_name", weekdays=False), "week")
    made = panels.sector_analysis(b, weeks, src.bars(spark, sf_dir), j1_primary_sector(spark, sf_dir))
    return made.select(*(c for c in made.columns if c != "related"), F.size("related").alias("n_related"), F.col("related")[0]["symbol"].alias("closest"))


_YEAR = "CASE WHEN above_year IS NULL THEN 'unknown' ELSE CASE WHEN above_year THEN 'above year line' ELSE 'below year line' END || CASE WHEN year_distance IS NULL THEN '' ELSE printf(' (%+.1f%%)', year_distance) END END"


@register("p19_sector_view", f"SELECT symbol, {_YEAR} AS year, CASE WHEN in_order THEN 'in order' WHEN NOT in_order THEN 'not in order' ELSE 'unknown' END AS averages, CASE WHEN strength IS NULL THEN '-' ELSE printf('%.1f', strength) || CASE WHEN strength_up THEN ' up' ELSE ' down' END END AS strength, candle_daily, candle_weekly, acc_level, n_related FROM ({ORACLE_SQL['x1_sector_analysis']})")
def p19_sector_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, weeks = src.bars(spark, sf_dir, "r_name"), quality.resample(src.bars(spark, sf_dir, "r_name", weekdays=False), "week")
    return panels.sector_view(panels.sector_analysis(b, weeks, src.bars(spark, sf_dir), j1_primary_sector(spark, sf_dir)))
