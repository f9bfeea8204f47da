"""Queries of wave verdicts, the ten steps and combined scores; their SQL is built on that of the queries that they combine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import indicators as ind
from quantloom.operators import jobs, portfolio, quality, records, rules, waves
from quantloom.plans import sql
from quantloom.plans.catalog import _PASS, _RET, _RHO, ORACLE_SQL, _eval_sql, full_evaluation, register
from quantloom.plans.jobs import _verdicts
from quantloom.plans.more import _positions
from quantloom.plans.sql import IND, cross, over
from quantloom.sources import bars as src

_STOP = "coalesce(stop > 0 AND entry > stop, false)"
#: Verdicts of all symbols.
_RULES = f"""WITH e AS (SELECT v.*, coalesce(a.trend_ok, false) AS trend_ok, coalesce(a.known_periods, 0) AS known_periods, a.month_direction FROM ({ORACLE_SQL["v2_wave_structure"]}) v LEFT JOIN ({ORACLE_SQL["v1_period_alignment"]}) a USING (symbol)),
h AS (SELECT *, trend_ok AND wave1_ok AND wave2_ok AND breakout AND {_STOP} AND NOT chase_risk AS hard FROM e),
r AS (SELECT *, [trend_ok, wave1_ok, wave2_ok, shrinks, breakout, expands, {_STOP}, NOT chase_risk, hard AND breakout] AS rules FROM h),
f AS (SELECT *, list_filter(range(1, 10), lambda i: NOT rules[i] AND i <> 4 AND i <> 6) AS failed FROM r),
verdicts AS (SELECT *, round(len(list_filter(rules, lambda x: x)) / 9::DOUBLE * 100, 1) AS quality, CASE WHEN known_periods < 2 THEN 'avoid' WHEN len(failed) = 0 THEN 'candidate' WHEN phase IN ('second wave unfit', 'no first wave') THEN 'avoid' ELSE 'watch' END AS verdict FROM f),
flagged AS (SELECT *, breakout AND exhausted AS spent, [trend_ok, wave1_ok AND coalesce(month_direction <> -1, false), wave1_ok, wave2_exists, shrinks AND stable, breakout, breakout AND len(failed) = 0, {_STOP}] AS fl FROM verdicts),
steps AS (SELECT *, CASE WHEN spent THEN 10 WHEN fl[6] AND fl[7] THEN 9 ELSE greatest(coalesce(list_position(fl, false), 0), 1) END AS step FROM flagged) """  # fmt: skip

ORACLE_SQL["v3_rules_and_verdict"] = _RULES + "SELECT symbol, phase, array_to_string(failed, ',') AS failed_hard, quality, verdict FROM verdicts"
ORACLE_SQL["v10_attached_waves"] = _RULES + f"""SELECT symbol, score, CASE WHEN row_number() OVER (ORDER BY score DESC NULLS LAST, symbol) <= 20 THEN coalesce(verdict, 'not_evaluated') ELSE 'not_evaluated' END AS verdict
FROM ({ORACLE_SQL["z8_resonance_score"]}) LEFT JOIN (SELECT symbol, verdict FROM verdicts) USING (symbol)"""
#: Sizes and the scale of the candidates' correlated risk, over all verdicts; their correlations are those among candidates.
ORACLE_SQL["v9_portfolio_evaluation"] = _RULES + f""", ps AS (SELECT symbol, verdict, entry, stop, CASE WHEN entry - stop > 0 THEN floor(10000.0::DOUBLE / (entry - stop)) END AS br, floor(200000.0::DOUBLE / entry) AS bc FROM verdicts),
pz AS (SELECT *, coalesce(least(br, bc), 0)::BIGINT AS shares FROM ps), rk AS (SELECT symbol, shares * (entry - stop) AS r FROM pz WHERE verdict = 'candidate' AND shares > 0),
al AS (SELECT sqrt(greatest(coalesce((SELECT sum(r * r) FROM rk), 0) + coalesce((SELECT sum(x.r * y.r * rho) * 2 FROM ({over("SELECT a, b, rho FROM rho", _RET, _RHO)}) JOIN rk x ON x.symbol = a JOIN rk y ON y.symbol = b), 0), 0)) AS total),
sc AS (SELECT least(1, CASE WHEN total > 0 THEN 60000.0::DOUBLE / total ELSE 1 END) AS scale FROM al),
pe AS (SELECT *, CASE WHEN verdict = 'candidate' AND shares > 0 THEN floor(shares * scale) ELSE 0 END::BIGINT AS suggested_shares FROM pz CROSS JOIN sc)
SELECT symbol, verdict, shares, suggested_shares, round(suggested_shares * coalesce(entry - stop, 0), 2) AS suggested_risk, round(scale, 4) AS scale FROM pe"""


#: The actions as an SQL list.
_ACTIONS = "[" + ", ".join("'" + a.replace("'", "''") + "'" for a in waves.NEXT_ACTIONS) + "]"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.ten_steps(_verdicts(spark, sf_dir), _positions(spark, sf_dir))


@register("v4_ten_steps", _RULES + f"SELECT symbol, verdict, step::INT AS step, {waves.STEPS}[step] AS step_name, {_ACTIONS}[step] AS next_action, array_to_string(list_transform(fl || [breakout AND NOT spent, spent], lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS flags FROM steps")
def v4_ten_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_join(F.transform("flags", lambda x: F.when(x, "1").otherwise("0")), "")
    return _steps(spark, sf_dir).select("symbol", "verdict", "step", "step_name", "next_action", flags.alias("flags"))


@register("v4_step_table", _RULES + f"""SELECT symbol, i::INT AS no, {waves.STEPS}[i] AS name, CASE WHEN i < step THEN 'passed' WHEN i = step THEN 'current' ELSE 'open' END AS status, (fl || [breakout AND NOT spent, spent])[i] AS flag
FROM steps, range(1, 11) AS t(i)""")
def v4_step_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.step_table(_steps(spark, sf_dir))


@register("t8_furthest_steps", _RULES + "SELECT symbol, step::INT AS step, (SELECT max(step) FROM steps)::INT AS furthest FROM steps WHERE step >= 2")
def t8_furthest_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.reached(_steps(spark, sf_dir), 2).select("symbol", "step", "furthest")


@register("t8_closest_pairs", over("SELECT a, b, rho FROM rho WHERE NOT assumed ORDER BY rho DESC, a, b LIMIT 5", _RET, _RHO))
def t8_closest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.closest_pairs(portfolio.correlations(ind.daily_returns(src.bars(spark, sf_dir)))).select("a", "b", "rho")


@register("v11_wave_scan", _RULES + """SELECT symbol, phase, verdict, quality, NULL::BIGINT AS n_bars FROM verdicts
UNION ALL SELECT symbol, 'too few bars', 'refused', NULL, count(*) FROM (""" + ORACLE_SQL["w1_sma_set"] + ") GROUP BY symbol HAVING count(*) < 60")
def v11_wave_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts, and the symbols refused for too few bars, in one table."""
    found, refused = jobs.scan_waves(src.bars(spark, sf_dir), _positions(spark, sf_dir))
    found = found.select("symbol", "phase", "verdict", "quality", F.lit(None).cast("long").alias("n_bars"))
    return found.unionByName(refused.select("symbol", F.lit("too few bars").alias("phase"), F.lit("refused").alias("verdict"), F.lit(None).cast("double").alias("quality"), "n_bars"))


_ALL_LEGS = f"""(SELECT f.*, k.arrangement, k.close, k.ma20, coalesce({_PASS}, false) AS yearline_pass, coalesce(k.arrangement = 1, false) OR coalesce(k.close > k.ma20, false) AS loose,
  act AND market_trend = 'up' AND sector_up AND f.strict AND position <> 'high' AND score >= 85 AS true_three FROM fin f JOIN (SELECT * EXCLUDE (strict, act, cs) FROM lastk) k USING (symbol, dt))"""
_YES = lambda e: f"CASE WHEN {e} THEN 'yes' WHEN NOT {e} THEN 'no' ELSE '-' END"
_THREE = "(strict AND coalesce(sector_up, false) AND market_trend = 'up')"


@register("z9_three_resonance", _eval_sql(f"SELECT symbol, dt, loose AS stock_loose, strict AS stock_strict, market_trend = 'up' AS market_up, sector_up, {_THREE} AS three_resonance FROM {_ALL_LEGS}"))
def z9_three_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.three_resonance(full_evaluation(spark, sf_dir)).select("symbol", "dt", "stock_loose", "stock_strict", "market_up", "sector_up", "three_resonance")


@register("p14_flat_result", _eval_sql(f"""SELECT symbol, dt, coalesce(sector, '-') AS sector, coalesce(position, '-') AS position, round(score, 5) AS score, {_YES("yearline_pass")} AS yearline, {_YES("strict")} AS strict, {_YES("sector_up")} AS sector_up,
  {_YES("(market_trend = 'up')")} AS market_up, {_YES("act")} AS active, {_YES(_THREE)} AS three, {_YES("true_three")} AS true_three FROM {_ALL_LEGS}"""))
def p14_flat_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z17's nested result, flattened."""
    return ind.rounded(rules.flat_result(rules.nested_result(full_evaluation(spark, sf_dir))))


@register("z16_row_gates", _eval_sql(f"SELECT symbol, score >= 85.0::DOUBLE AS score_ok, act AS capital_active, market_trend = 'up' AS market_up, sector_up AS industry_up, strict AS stock_strict, position <> 'high' AS market_not_high FROM {_ALL_LEGS}"))
def z16_row_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.row_gates(rules.nested_result(full_evaluation(spark, sf_dir)))


#: A scan with options of its own: a lower threshold, the high-position gate only softly.
_OTHER = {"threshold": 70.0, "high_gate": "soft"}


@register("z16_relaxed_gates", _eval_sql(f"""SELECT symbol, score >= 70 AS score_ok, act AS capital_active, market_trend = 'up' AS market_up, sector_up AS industry_up, strict AS stock_strict, true AS market_not_high, position <> 'high' AS not_high_if_hard FROM {_ALL_LEGS}"""))
def z16_relaxed_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold and gate come from each stored row; the hard gate is derived anew beside it."""
    nested = rules.nested_result(full_evaluation(spark, sf_dir, **_OTHER))
    hard = rules.row_gates(nested, force_hard=True).select("symbol", F.col("market_not_high").alias("not_high_if_hard"))
    return rules.row_gates(nested).join(hard, "symbol")


@register("z16_option_echo", _eval_sql("SELECT 'ma' AS market_mode, 70.0::DOUBLE AS true_threshold, 8.0::DOUBLE AS capital_min_score, 1.5::DOUBLE AS capital_min_volume_ratio, NULL::DOUBLE AS index_max_lag_days, 'soft' AS high_position_gate, 1.5::DOUBLE AS volume_boost_ratio, market_trend = 'up' AS market_up, position, false AS downgraded FROM lastm"))
def z16_option_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = rules.nested_result(full_evaluation(spark, sf_dir, **_OTHER))
    return rules.effective_options(nested).join(rules.market_leg_snapshot(nested).select("market_up", "position", "downgraded"))


@register("p7_replayed_evaluation", _eval_sql("SELECT symbol, dt, sector, strict AS stock_strict, market_trend, position, sector_up, cs AS capital_score, act AS capital_active, score FROM fin").replace("FROM lineitem", "FROM (SELECT * FROM lineitem WHERE l_shipdate::DATE <= DATE '1997-06-30')"))
def p7_replayed_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full evaluation of a past day: no input shows a later bar."""
    made = full_evaluation(spark, sf_dir, as_of=F.lit("1997-06-30").cast("date"))
    return made.select("symbol", "dt", "sector", "stock_strict", "market_trend", "position", "sector_up", "capital_score", "capital_active", "score")


@register("x7_true_resonance", _eval_sql(f"SELECT symbol, sector, score FROM {_ALL_LEGS} WHERE true_three"))
def x7_true_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_evaluation(spark, sf_dir).where("true_resonance").select("symbol", "sector", "score")


@register("n4_annotated_alerts", over(f"""SELECT symbol, dt, now, n_regionkey = 1 AS held, now = 'golden' AND coalesce(above, false) AS above_5w FROM (SELECT symbol, dt, CASE x WHEN 1 THEN 'golden' ELSE 'death' END AS now FROM (SELECT *, {cross("ma5p", "ma10p", "ma5", "ma10")} AS x FROM ind) WHERE x <> 0)
  JOIN nation ON n_name = symbol LEFT JOIN (SELECT symbol, arg_max(close, dt) > avg(close) AND count(*) = 5 AS above FROM (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) <= 5) GROUP BY 1) USING (symbol)""", IND, sql.weeks()))  # fmt: skip
def n4_annotated_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosses of two means stand for the alerts, the nations of a region for the watchlist."""
    b = ind.ma_signals(ind.moving_averages(src.bars(spark, sf_dir))).where("ma_cross <> 0")
    alerts = b.select("symbol", "dt", F.when(F.col("ma_cross") == 1, "golden").otherwise("death").alias("now"))
    watchlist = src.table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"), (F.col("n_regionkey") == 1).alias("held"))
    return records.annotate_alerts(alerts, watchlist, quality.resample(src.bars(spark, sf_dir, weekdays=False), "week"))
