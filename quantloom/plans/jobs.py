"""Registered queries of the longer jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round
from quantloom.operators import indicators as ind
from quantloom.operators import jobs, waves
from quantloom.plans.catalog import _GAPPY, _SNAP, _ema, _eval_sql, full_evaluation, register
from quantloom.plans.more import _positions
from quantloom.plans.sql import W, cross, over
from quantloom.sources import bars as src


@register("w15_macd_summary", _ema(f"""SELECT symbol, dt, round(line, 4) AS dif, round(sig, 4) AS dea, round((line - sig) * 2, 4) AS hist, CASE WHEN line > sig THEN 'golden' WHEN line < sig THEN 'death' ELSE 'flat' END AS state,
  CASE {cross("lag(line) OVER w", "lag(sig) OVER w", "line", "sig")} WHEN 1 THEN 'golden' WHEN -1 THEN 'death' END AS cross, count(*) OVER (PARTITION BY symbol) AS n_bars FROM e {W} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1"""))  # fmt: skip
def w15_macd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.macd_summary(src.bars(spark, sf_dir))


def _snapshots(b: DataFrame) -> DataFrame:
    return b.where(F.month("dt") == 12).groupBy("symbol", F.last_day("dt").alias("as_of")).agg((F.sum("amount") / 1000).alias("shares"))


_FILL = f"""b0 AS (SELECT g.symbol, g.dt, t, round(volume * 100 / shares, 4) AS x FROM g ASOF LEFT JOIN snap s ON g.symbol = s.symbol AND g.dt >= s.as_of),
b1 AS (SELECT symbol, dt, coalesce(t, CASE WHEN x > 0 AND x < 80 THEN x END) AS t, CASE WHEN t IS NOT NULL THEN 'feed' WHEN x > 0 AND x < 80 THEN 'derived' END AS s FROM b0),
b2 AS (SELECT *, count(t) OVER (w ROWS UNBOUNDED PRECEDING) AS isl, last_value(t IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS lv FROM b1 {W}),
b3 AS (SELECT symbol, dt, CASE WHEN t IS NOT NULL THEN t WHEN isl > 0 AND count(*) FILTER (t IS NULL) OVER (PARTITION BY symbol, isl) <= 5 THEN lv END AS turn, t IS NULL AS gap, s FROM b2)"""


@register("r19_turnover_backfill", over("SELECT symbol, dt, turn, CASE WHEN gap AND turn IS NOT NULL THEN 'filled' ELSE s END AS turn_source FROM b3", _GAPPY, _SNAP, _FILL))
def r19_turnover_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.gappy_bars(spark, sf_dir)
    return jobs.backfill_turnover(rows, _snapshots(rows)).select("symbol", "dt", "turn", "turn_source")


@register("a6_turnover_qa", over("SELECT count(*) AS n_rows, (SELECT count(t) FROM g) AS known_before, count(turn) AS known_after, count(*) FILTER (s = 'derived') AS derived, count(*) FILTER (gap AND turn IS NOT NULL) AS filled FROM b3", _GAPPY, _SNAP, _FILL))
def a6_turnover_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.gappy_bars(spark, sf_dir)
    return jobs.backfill_counters(rows, jobs.backfill_turnover(rows, _snapshots(rows)))


@register("a13_counterfactual_gates", _eval_sql("""SELECT count(*) FILTER (position <> 'high' AND score >= 85) AS hard_true, count(*) FILTER (score >= 85) AS soft_true, count(*) FILTER (score + CASE WHEN position = 'high' THEN 15 ELSE 0 END >= 85) AS off_true
  FROM fin WHERE act AND market_trend = 'up' AND sector_up AND strict"""))  # fmt: skip
def a13_counterfactual_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.counterfactual_gates(full_evaluation(spark, sf_dir))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.rules_and_verdict(waves.wave_structure(src.bars(spark, sf_dir)), _positions(spark, sf_dir))


@register("v9_portfolio_evaluation")
def v9_portfolio_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _verdicts(spark, sf_dir).select("symbol", "entry", "stop", "verdict")
    made = jobs.evaluate_portfolio(found, ind.daily_returns(src.bars(spark, sf_dir)), lot=1)
    return made.select("symbol", "verdict", "shares", "suggested_shares", "suggested_risk", sql_round("scale", 4).alias("scale"))


@register("v10_attached_waves")
def v10_attached_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.attach_waves(full_evaluation(spark, sf_dir).select("symbol", "score"), _verdicts(spark, sf_dir), most=20)
