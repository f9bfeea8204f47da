"""Registered queries of adaptive windows and platforms, boxes of periods, the checklist and the comprehensive signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round
from quantloom.operators import indicators as ind
from quantloom.operators import quality, rules, waves
from quantloom.operators.indicators import rounded
from quantloom.plans import sql
from quantloom.plans.catalog import _EMA, _SECTOR, ORACLE_SQL, full_evaluation, j1_primary_sector, register
from quantloom.plans.signals import r4_main_wave_signal
from quantloom.plans.sql import IND, W, cross, over
from quantloom.sources import bars as src

_K = lambda unknown: f"CASE WHEN tm IS NULL THEN {unknown} WHEN round_even(tm, 2) >= 10 THEN 2.2 WHEN round_even(tm, 2) >= 3 THEN 1.8 ELSE 1.5 END::DOUBLE"
_WINDOWS = f"""aw AS (SELECT *, greatest(10, least(14, round_even(n / 4.0::DOUBLE, 0)))::INT AS m FROM (SELECT *, CASE WHEN tm IS NULL THEN 30 ELSE round_even(least(60, greatest(10, 70 / tm)), 0) END::INT AS n, {_K(1.8)} AS k FROM (SELECT *, CASE WHEN turn_ma20 > 0 THEN turn_ma20 END AS tm FROM ind)))"""
_SPANS = range(10, 15)
_ATR = f"""at0 AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr, coalesce(close >= round_even(c1 * 1.1::DOUBLE, 2), false) AS at_limit FROM aw),
at1 AS (SELECT *, {", ".join(f"CASE WHEN at_limit THEN avg(tr) OVER (w ROWS BETWEEN {i - 1} PRECEDING AND CURRENT ROW) ELSE tr END AS tr{i}" for i in _SPANS)} FROM at0 {W}),
at2 AS (SELECT *, coalesce(lag(at_limit) OVER w, false) AS lb, CASE m {" ".join(f"WHEN {i} THEN {sql.mean(f'tr{i}', i)}" for i in _SPANS)} END AS atr FROM at1 {W})"""
_VAP = """vp0 AS (SELECT symbol, dt, rn, n, volume, low + (close - low) / (CASE WHEN high = low THEN 0.001 ELSE high - low END) * (high - low) AS p FROM at2),
vp1 AS (SELECT a.symbol, a.dt, b.p, b.volume AS v, min(b.p) OVER k AS lo, (max(b.p) OVER k - min(b.p) OVER k) / 49 AS st
  FROM vp0 a JOIN vp0 b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - a.n + 1 AND a.rn WHERE a.rn >= greatest(a.n, 30) WINDOW k AS (PARTITION BY a.symbol, a.dt)),
vp2 AS (SELECT symbol, dt, lo, st, coalesce(least(floor((p - lo) / nullif(st, 0)), 48), 0) AS bin, sum(v) AS v FROM vp1 GROUP BY ALL),
vpoc AS (SELECT symbol, dt, arg_max(CASE WHEN st = 0 THEN lo ELSE lo + (bin + 0.5::DOUBLE) * st END, ROW(v, -bin)) AS poc FROM vp2 GROUP BY 1, 2),
ap0 AS (SELECT at2.*, CASE WHEN atr IS NOT NULL THEN poc END AS poc FROM at2 LEFT JOIN vpoc USING (symbol, dt)),
ap AS (SELECT *, poc + k * atr AS upper, poc - k * atr AS lower, coalesce(close > poc + k * atr AND close > open AND (close - low) / (CASE WHEN high = low THEN 0.001 ELSE high - low END) > 0.5 AND NOT lb, false) AS broke FROM ap0)"""


@register("w24_adaptive_windows", over("SELECT symbol, dt, round(tm, 5) AS turn_mean20, n AS lookback, m AS atr_window, k FROM aw", IND, _WINDOWS))
def w24_adaptive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.adaptive_windows(src.bars(spark, sf_dir)).select("symbol", "dt", "turn_mean20", "lookback", "atr_window", "k"))


@register("w24_adaptive_platform", over("SELECT symbol, dt, round(poc, 8) AS poc, round(atr, 5) AS atr, round(upper, 5) AS upper, round(lower, 5) AS lower, broke AS breakout FROM ap", IND, _WINDOWS, _ATR, _VAP))
def w24_adaptive_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ind.adaptive_platform(ind.adaptive_windows(src.bars(spark, sf_dir)))
    return rounded(made.select("symbol", "dt", sql_round("poc", 8).alias("poc"), "atr", "upper", "lower", "breakout"), exact=("poc",))


def _box_sql(unit: str) -> str:
    """<unit>x: the box of every day. Full periods before the day's own are counted and joined by their number."""
    u, label, least = unit[0], "date_trunc('week', dt)::DATE + 4" if unit == "week" else "last_day(dt)", quality.LEAST_BARS[unit]
    near = lambda c, t: f"{c} >= {t} * 0.98::DOUBLE"
    return f"""{u}0 AS (SELECT symbol, {label} AS period, max(high) AS h, min(low) AS l, arg_max(close, dt) AS c, count(*) AS n FROM bars GROUP BY 1, 2),
{u}1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period) AS i FROM {u}0 WHERE n >= {least}),
{u}2 AS (SELECT a.symbol, a.period, count(b.i) AS s FROM {u}0 a LEFT JOIN {u}1 b ON b.symbol = a.symbol AND b.period < a.period GROUP BY 1, 2),
{u}3 AS (SELECT {u}2.symbol, {u}2.period, s, max(h) AS h, min(l) AS l, arg_max(c, i) AS c FROM {u}2 LEFT JOIN {u}1 b ON b.symbol = {u}2.symbol AND i BETWEEN s - 18 AND s GROUP BY 1, 2, 3),
{u}4 AS (SELECT symbol, dt, close, {label} AS period, max(high) OVER (PARTITION BY symbol, {label} ORDER BY dt) AS h0, min(low) OVER (PARTITION BY symbol, {label} ORDER BY dt) AS l0 FROM bars),
{u}5 AS (SELECT {u}4.symbol, dt, close, c, CASE WHEN s + 1 >= 5 THEN greatest(h0, coalesce(h, h0)) END AS t, CASE WHEN s + 1 >= 5 THEN least(l0, coalesce(l, l0)) END AS o FROM {u}4 JOIN {u}3 USING (symbol, period)),
{unit}x AS (SELECT symbol, dt, t AS {unit}_top, o AS {unit}_bottom, CASE WHEN t IS NULL THEN 'unknown' WHEN close > t * 1.02::DOUBLE THEN CASE WHEN c <= t THEN 'breaks out' ELSE 'above top' END WHEN {near("close", "t")} THEN 'tests top'
  WHEN close < o * 0.98::DOUBLE THEN 'breaks down' WHEN close <= o * 1.02::DOUBLE THEN 'falls to bottom' ELSE 'inside' END AS {unit}_box FROM {u}5)"""


@register("w20_period_boxes", over("SELECT symbol, dt, week_top, week_bottom, week_box, month_top, month_bottom, month_box FROM weekx JOIN monthx USING (symbol, dt)", _box_sql("week"), _box_sql("month")))
def w20_period_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rules.period_box(rules.period_box(src.bars(spark, sf_dir), "week"), "month")
    return made.select("symbol", "dt", *(f"{u}_{c}" for u in ("week", "month") for c in ("top", "bottom", "box")))


_CROSS = f"mc AS (SELECT symbol, dt, line, sig, {cross('lag(line) OVER w', 'lag(sig) OVER w', 'line', 'sig')} AS mx FROM e {W})"
_RULE = f"""pr0 AS (SELECT ap.*, mx, max(high) OVER t AS bt, min(low) OVER t AS bb, avg(close) OVER t AS ac FROM ap JOIN mc USING (symbol, dt) WINDOW t AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
pr1 AS (SELECT *, coalesce(rn >= 10 AND (bt - bb) / ac * 100 < 15, false) AS narrow, coalesce(close > ma20, false) AS over20, coalesce(volume_ratio > 1.5 AND mx = 1, false) AS vm FROM pr0),
pr AS (SELECT *, narrow AND over20 AND vm AS conf, broke OR (narrow AND over20 AND vm) AS sig6, narrow AND over20 AND NOT (broke OR vm) AND (close - bb) / bb * 100 < 5 AS flat FROM pr1)"""
_recursive = lambda text: text.replace("WITH ", "WITH RECURSIVE ", 1)


@register("r6_platform_rule", _recursive(over("""SELECT symbol, dt, lookback, platform_signal, buy_flat, platform_state, round(platform_top, 5) AS platform_top, round(platform_bottom, 5) AS platform_bottom, week_box, month_box FROM (
  SELECT symbol, dt, n AS lookback, sig6 AS platform_signal, flat AS buy_flat, CASE WHEN conf THEN 'confirmed' WHEN flat THEN 'buy flat' WHEN narrow THEN 'sideways' WHEN broke THEN 'confirmed' WHEN poc IS NOT NULL THEN 'sideways' ELSE 'unknown' END AS platform_state,
  coalesce(upper, bt) AS platform_top, coalesce(lower, bb) AS platform_bottom FROM pr) JOIN weekx USING (symbol, dt) JOIN monthx USING (symbol, dt)""", IND, _WINDOWS, _ATR, _VAP, _EMA, _CROSS, _RULE, _box_sql("week"), _box_sql("month"))))  # fmt: skip
def r6_platform_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's cascade with the weekly and monthly boxes, on every date."""
    b = ind.macd_signals(ind.macd(ind.volume_ratio(ind.moving_averages(src.bars(spark, sf_dir), (20,)))))
    made = rules.platform_rule(ind.adaptive_platform(ind.adaptive_windows(b)))
    made = rules.period_box(rules.period_box(made, "week"), "month")
    return rounded(made.select("symbol", "dt", "lookback", "platform_signal", "buy_flat", "platform_state", "platform_top", "platform_bottom", "week_box", "month_box"))


_NEWEST_WINDOWS = f"""nw AS (SELECT symbol, n, m, k FROM (SELECT symbol, dt, greatest(10, least(14, round_even(n / 4.0::DOUBLE, 0)))::INT AS m, n, k FROM (SELECT symbol, dt, CASE WHEN tm IS NULL THEN 30 ELSE round_even(least(60, greatest(10, 70 / tm)), 0) END::INT AS n, {_K(1.5)} AS k FROM (SELECT *, CASE WHEN turn_ma20 > 0 THEN turn_ma20 END AS tm FROM ind)))
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1),
aw AS (SELECT r.* EXCLUDE (rn, c1), row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn, lag(close) OVER (PARTITION BY symbol ORDER BY dt) AS c1, nw.n, nw.m, nw.k FROM (SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) <= 120) r JOIN nw USING (symbol))"""


@register("r14_adaptive_breakout", over("""SELECT symbol, dt, breakout_dt, round(support, 5) AS support, round(least_after, 5) AS least_after, CASE WHEN breakout_dt IS NULL THEN 'none' WHEN least_after < support * 0.985::DOUBLE THEN 'false' WHEN least_after <= support * 1.02::DOUBLE THEN 'pullback' ELSE 'direct' END AS quality
  FROM (SELECT ap.symbol, max(ap.dt) AS dt, any_value(b.dt) AS breakout_dt, any_value(b.upper) AS support, min(ap.close) FILTER (ap.dt > b.dt) AS least_after FROM ap LEFT JOIN (SELECT symbol, dt, upper FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS lft FROM ap)
    WHERE lft <= 60 AND broke QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1) b ON b.symbol = ap.symbol GROUP BY 1)""", IND, _NEWEST_WINDOWS, _ATR, _VAP))  # fmt: skip
def r14_adaptive_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14 with look-back, ATR window and band factor of each symbol's newest bar."""
    return rounded(rules.breakout_quality(ind.adaptive_series(src.bars(spark, sf_dir))))


_SHIFTS = """sg AS (SELECT *, close / lag(close, 5) OVER w - 1 AS t5, close / lag(close, 20) OVER w - 1 AS t20, close / lag(close, 60) OVER w - 1 AS t60, poc / lag(poc, 20) OVER w - 1 AS p20, poc / lag(poc, 60) OVER w - 1 AS p60, max(close) OVER (PARTITION BY symbol) AS hi, min(close) OVER (PARTITION BY symbol) AS lo,
  CASE WHEN rn >= 25 THEN round(avg(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(volume) OVER (w ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING), 3) END AS vt,
  CASE WHEN rn >= 20 THEN round((max(high) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - min(low) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) / avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) END AS am FROM ap WINDOW w AS (PARTITION BY symbol ORDER BY dt)
  QUALIFY lead(dt) OVER w IS NULL),
sk AS (SELECT *, CASE WHEN rn < 30 THEN 0 WHEN close >= 0.9::DOUBLE * hi AND NOT close <= 1.1::DOUBLE * lo AND vt > 1.1 AND t20 < 0.05 THEN 1 WHEN t20 < -0.03 AND vt > 1.1 THEN 1 WHEN t20 > 0.03 AND t5 < -0.01 AND vt < 0.9 AND (p20 IS NULL OR p20 > -0.02) THEN 2
  WHEN t20 > 0.08 AND (vt IS NULL OR vt >= 0.9) AND (p20 IS NULL OR p20 > 0.02) THEN 3 WHEN abs(t20) <= 0.05 AND vt > 1.1 AND (close <= 1.1::DOUBLE * lo OR coalesce(p20 > 0, false)) AND (am IS NULL OR am < 0.2) THEN 4 WHEN abs(t20) <= 0.05 AND am < 0.15 THEN 5 ELSE 6 END AS kind FROM sg)"""


@register("r13_stage_with_shifts", over("""SELECT symbol, dt, round(t60, 5) AS t60, round(p20, 5) AS poc_shift20, round(p60, 5) AS poc_shift60, ['unknown', 'distribution', 'shakeout', 'rally', 'accumulation', 'consolidation', 'consolidation'][kind + 1] AS stage, [0.0, 0.7, 0.7, 0.75, 0.7, 0.6, 0.5][kind + 1]::DOUBLE AS stage_confidence FROM sk""", IND, _NEWEST_WINDOWS, _ATR, _VAP, _SHIFTS, ticks=sql.SUPPLIER_TICKS))
def r13_stage_with_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest stage of every supplier, with the shifts of its POC."""
    made = ind.latest(waves.stage(ind.adaptive_series(src.bars(spark, sf_dir, "l_suppkey"))))
    return rounded(made.select("symbol", "dt", "t60", "poc_shift20", "poc_shift60", "stage", "stage_confidence"))


_SECTORS = sql.SECTOR_TICKS.replace("ticks AS", "st AS") + ", " + sql.ALL_DAYS.replace("alldays AS", "sd AS").replace("FROM ticks", "FROM st") + ", sbars AS (SELECT * FROM sd WHERE isodow(dt) < 6), " + _SECTOR.replace("FROM bars", "FROM sbars")
_R = lambda n: f"(w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_CHECKS = f"""ck AS (SELECT symbol, dt, [coalesce(rn >= 60 AND (max(high) OVER {_R(60)} - min(low) OVER {_R(60)}) / avg(close) OVER {_R(60)} * 100 < 25, false), coalesce(rn >= 65 AND ma60 > lag(ma60, 5) OVER w, false), coalesce(rn >= 21 AND close >= max(high) OVER {_R(20)}, false),
  coalesce(rn >= 21 AND volume / avg(volume) OVER {_R(20)} >= 2, false), coalesce(lag(low) OVER w >= min(low) OVER {_R(20)} * 0.98::DOUBLE AND line > sig AND (lag(line) OVER w <= lag(sig) OVER w OR abs(line) < close * 0.01::DOUBLE), false),
  coalesce(rn >= 6 AND rsi > 50 AND rsi >= lag(rsi, 5) OVER w, false), coalesce(rn >= 4 AND coalesce(close > c1, false)::INT + coalesce(lag(close) OVER w > lag(close, 2) OVER w, false)::INT + coalesce(lag(close, 2) OVER w > lag(close, 3) OVER w, false)::INT >= 2, false), coalesce(sc > 12.5, false)] AS c
  FROM (SELECT ind.*, line, sig, sc, CASE WHEN loss = 0 THEN CASE WHEN gain > 0 THEN 100.0 END ELSE 100 - 100 / (1 + gain / loss) END AS rsi FROM ind JOIN e USING (symbol, dt) JOIN nation ON n_name = ind.symbol JOIN region ON n_regionkey = r_regionkey LEFT JOIN z ON z.symbol = r_name AND z.dt = ind.dt) {W})"""


@register("r7_checklist", _recursive(over(f"""SELECT symbol, dt, {", ".join(f"c[{i}] AS {c}" for i, c in enumerate(rules.CHECKS, 1))}, m::INT AS checks_met, m / 8::DOUBLE AS checks_share, CASE WHEN m >= 6 THEN 'likely' WHEN m >= 4 THEN 'possible' WHEN m >= 2 THEN 'watch' ELSE 'not yet' END AS checks_verdict
  FROM (SELECT *, len(list_filter(c, lambda x: x)) AS m FROM ck)""", IND, _SECTORS, _EMA, _CHECKS)))  # fmt: skip
def r7_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every date, with the sector's trend of that day."""
    sectors = rules.sector_score(src.bars(spark, sf_dir, "r_name")).select(F.col("symbol").alias("sector"), "dt", "sector_up")
    b = ind.rsi(ind.macd(ind.moving_averages(src.bars(spark, sf_dir), (60,)))).join(j1_primary_sector(spark, sf_dir), "symbol", "left").join(sectors, ["sector", "dt"], "left")
    return rules.main_wave_checklist(b, F.col("sector_up")).select("symbol", "dt", *rules.CHECKS, "checks_met", "checks_share", "checks_verdict")


@register("r9_comprehensive_signal", f"""SELECT symbol, CASE WHEN yearline_pass THEN round_even(score * 0.6::DOUBLE + CASE WHEN main_wave THEN 16.0 ELSE 0.0 END::DOUBLE, 1) ELSE 0.0 END::DOUBLE AS final_score,
  CASE WHEN NOT yearline_pass THEN 'wait: year line not passed' WHEN true_resonance AND main_wave THEN 'focus strongly: true resonance in a main wave' WHEN true_resonance THEN 'focus: true resonance' WHEN main_wave THEN 'follow: main wave' WHEN score >= 70 THEN 'focus' WHEN score >= 45 THEN 'follow' ELSE 'wait' END AS advice,
  yearline_pass AND main_wave AS signal_main_wave, yearline_pass AND true_resonance AS signal_true_resonance, score FROM ({ORACLE_SQL["z8_resonance_score"]}) JOIN (SELECT symbol, yearline_pass, main_wave FROM ({ORACLE_SQL["r4_main_wave_signal"]})) USING (symbol)""")
def r9_comprehensive_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    waves = r4_main_wave_signal(spark, sf_dir).select("symbol", "main_wave")
    made = rules.comprehensive_signal(full_evaluation(spark, sf_dir).join(waves, "symbol", "left"))
    return made.select("symbol", "final_score", "advice", "signal_main_wave", "signal_true_resonance", "score")
